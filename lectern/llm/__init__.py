"""Training-data operators: scoring, deduplicating, scanning, tokenising and packing whole document tables.

Nothing outside this package imports it. Each operator module holds the general
operator and the thin ``opN_*`` query that applies it to one table.
"""
