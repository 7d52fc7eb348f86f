"""Training-data operators (deduplication, scoring, mixing, sharding, ...).

Nothing outside this subpackage imports it; ``queries.py`` holds the queries
that the entry module registers when the subpackage is present.
"""
