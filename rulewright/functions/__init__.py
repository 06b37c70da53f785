"""Atoms and targets as Spark columns."""
