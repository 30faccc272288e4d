"""Training-data operators: chat formatting, search, tokens, dedup, quality, packing, PII.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface; ``queries`` holds the registered queries and their SQL.
"""
