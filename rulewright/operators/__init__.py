"""Operators on DataFrames of samples: apply, learn, lexicons, evaluation and more."""
