"""Training-data operators: mixing, near-duplicates, token output, packing, chat, scoring, PII, quality, joins.

Nothing outside this subpackage imports it; ``queries.py`` holds what ``__spark_entry__`` registers.
"""
