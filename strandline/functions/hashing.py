"""Digests and fingerprints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint_lines(*parts: Column) -> Column:
    """SHA-256 of the parts joined by newlines; a null part is empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def fingerprint_prefixed(*parts: Column) -> Column:
    """SHA-256 of the parts' UTF-8 bytes, each after its length as four big-endian bytes; no two lists of parts look alike."""
    piece = lambda p: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 8, "0")), p.cast("binary"))
    return F.sha2(F.concat(*[piece(F.coalesce(p.cast("string"), F.lit(""))) for p in parts]), 256)


def hash_order(seed: str, *parts: Column) -> Column:
    """Key of a deterministic random order."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def json_signature():
    """Arrow function (name, JSON arguments) → the call as its name and JSON with sorted keys at every depth; null if it is no object."""
    import json

    def signature(name, arguments):
        try:
            value = json.loads(arguments)
        except (TypeError, ValueError):
            return None
        return f"{name}:{json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(',', ':'))}" if isinstance(value, dict) else None

    @F.pandas_udf("string")
    def run(names: pd.Series, arguments: pd.Series) -> pd.Series:
        return pd.Series([signature(n, a) for n, a in zip(names, arguments, strict=True)], dtype="object")

    return run


def call_signature(name: Column, arguments: Column) -> Column:
    """Tool call as its name and JSON with sorted keys; ``arguments`` is a map."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(arguments)))
    return F.concat(name, F.lit(":"), F.to_json(ordered))
