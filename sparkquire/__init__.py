"""Spark-native analytics over large, disordered text collections."""
