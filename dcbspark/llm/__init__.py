"""Training-data operators: deduplication, filtering, search, mixing and tokenising of text tables.

Nothing else in the library imports this subpackage. Each module holds one operator with a general interface; ``queries``
derives the registered ``opN_`` digests from them and ``oracles`` holds their SQL.
"""
