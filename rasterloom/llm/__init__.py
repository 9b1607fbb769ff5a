"""Training-data operators: tokenising, filtering, deduplication and search over text tables.

Nothing outside this subpackage imports it. Each module holds one operator with a
general interface; ``queries`` derives the registered query results from them.
"""
