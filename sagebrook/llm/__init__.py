"""Training-data operators: deduplication, filters, models, tokenising and packing.

Nothing else in the package imports from here. ``queries.py`` lists the
registered queries and their DuckDB equivalents.
"""
