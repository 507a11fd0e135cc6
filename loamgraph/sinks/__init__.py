"""loamgraph.sinks"""
