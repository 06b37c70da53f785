"""Readers and writers of column text, rules, vocabularies, constraints and trees."""
