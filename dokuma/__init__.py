"""Spark-first text analytics: morphology-aware tokenising, corpus encoding and instruction-data processing."""
