"""Training-data operators: cleaning, deduplicating, mixing, packing and searching text corpora.

Nothing outside this subpackage imports it; the queries over the test tables are in ``queries.py``.
"""
