"""Vector arithmetic on arrays, and the codec of stored vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def invalid_reason(a: Column, dimensions: int) -> Column:
    """Why a vector cannot be indexed, or null."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(a.isNull() | (F.size(a) != dimensions), F.lit("DIMENSION"))
        .when(bad, F.lit("NOT_FINITE"))
        .when(F.forall(a, lambda x: x == 0), F.lit("ZERO"))
    )


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes with x0, y0, x1, y1."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def encode():
    """Arrow function: vector → base64 of its little-endian 32-bit floats."""
    @F.pandas_udf("string")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(encode_vector)

    return run


def decode():
    """Arrow function: the inverse of ``encode``."""
    @F.pandas_udf("array<float>")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(decode_vector)

    return run


def encode_vector(x) -> str | None:
    import base64

    import numpy as np

    return None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode()


def decode_vector(x):
    import base64

    import numpy as np

    return None if x is None else np.frombuffer(base64.b64decode(x, validate=True), "<f4").tolist()


def hashing_embedder(dimensions: int = 64):
    """Arrow function: text → unit vector of signed hashed tokens; stands in for an embedding service offline."""
    @F.pandas_udf("array<float>")
    def run(xs: pd.Series) -> pd.Series:
        return xs.map(lambda x: embed_text(x, dimensions))

    return run


def embed_text(text: str | None, dimensions: int) -> list[float]:
    import re
    import zlib

    import numpy as np

    v = np.zeros(dimensions)
    for t in re.findall(r"\w+", (text or "").lower()):
        h = zlib.crc32(t.encode())
        v[h % dimensions] += 1 if h >> 31 else -1
    n = np.linalg.norm(v)
    return (v / n if n else np.eye(1, dimensions)[0]).astype("float32").tolist()
