"""A PySpark-native engine for corpus curation and evaluation audits."""
