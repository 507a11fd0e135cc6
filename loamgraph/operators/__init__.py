"""loamgraph.operators"""
