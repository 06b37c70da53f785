"""Transformation rules over sequences, on Spark."""
