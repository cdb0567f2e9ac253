"""newsloom: a PySpark-native engine for collecting, grouping, classifying and auditing articles at scale."""
