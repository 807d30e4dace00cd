"""Spark-native engine for multilingual fact-verification benchmarks."""
