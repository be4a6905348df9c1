"""loamgraph.functions"""
