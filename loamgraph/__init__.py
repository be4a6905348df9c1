"""loamgraph: a PySpark-native analytics engine for knowledge graphs kept in a lakehouse."""

__version__ = "0.1.0"
