"""Training-data operators (chat formatting, filters, dedup, mixing, token counts, scans).

Nothing outside this folder imports it; ``queries`` and ``oracle_sql`` are
collected by ``strandline.llm.catalog``.
"""
