"""Training-data operators: quality rules, URL rules, sharding, tokens, joins, language models, chat.

Nothing outside this subpackage imports it. ``queries`` registers one query for each operator.
"""
