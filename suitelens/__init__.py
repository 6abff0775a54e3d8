"""suitelens: a PySpark-native engine for test-suite populations, run reports and their texts."""

__version__ = "0.1.0"
