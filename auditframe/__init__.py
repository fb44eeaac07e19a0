"""auditframe: a PySpark-native content-audit and evaluation engine."""

__version__ = "0.1.0"
