"""Training-data operators: sharding, chat, packing, licences, dedup, quality, BPE, HTML, language ID.

Nothing outside this subpackage imports it; ``queries.py`` holds its registered queries and SQL.
"""
