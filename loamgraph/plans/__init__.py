"""loamgraph.plans"""
