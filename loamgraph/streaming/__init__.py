"""loamgraph.streaming"""
