"""Declarations: column schemas, rule templates, rules and parameters, read from and written as text."""
