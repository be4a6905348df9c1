"""loamgraph.sources"""
