"""Spark-native analytics over functions of C code: extraction, labels, features, similarity, models, evaluation."""
