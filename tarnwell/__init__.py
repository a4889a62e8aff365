"""Tarnwell: a PySpark engine for explainable fraud-signal fusion and corpus preparation."""
