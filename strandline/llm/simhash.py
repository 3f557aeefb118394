"""SimHash near-duplicates: pivot distance tables behind an exact pigeonhole join.

Fingerprints: the majority of each bit of the 64-bit hashes of word shingles, in
Arrow batches with NumPy.  Only distinct fingerprints are compared, so exact copies
cost one aggregation.

Each distinct fingerprint's Hamming distances to ``PIVOTS`` reference fingerprints are computed once and stored
beside it; this table of coordinates is what candidates are judged by.

Two fingerprints that differ in at most three bits agree in all but three of any
blocks of their bits.  ``block_masks`` takes as many blocks as make the agreeing
bits more numerous than log2 of the fingerprints, so a bucket of fingerprints that
agree in them holds by chance less than a handful, at any size of corpus.  Within a bucket
the pairs whose coordinates differ by more than three anywhere are discarded, as the triangle
inequality allows; the others are verified, and what leaves the task is one link of each member to the least one that it reaches.

A bucket with more than ``small`` members is a cluster of near copies, whose coordinates
agree all, so no pivot tells them apart.  It is never paired: two of
its members that differ in at most three bits differ in bits that vary within the
bucket, and there is a value that is one such bit away from one and two from the
other.  Members send their neighbours at one and at two varying bits, and who meets
at a value links to the smallest that came by one bit; such links are verified as
well.  That keeps every component whole with work linear in the members.

``similar_documents`` is the wider search of the pipeline: fingerprints of ``WIDE`` bits over
the distinct five-word shingles of a text, linked where at least ``similarity`` of
the bits agree.  So wide a distance has no exact pigeonhole; candidates agree in all
of the sampled bits of one of several tables, as many as ``table_masks`` finds
necessary for the stated recall at that many documents.  In a bucket too large for a task, the distance to its
first member is the pivot: members within the distance link to it, and others are compared with those
alone whose pivot distance differs by no more than the triangle inequality allows.

Defined results: null and empty texts have fingerprint zero and link like any other;
fewer words than a shingle form one shingle; a null id gets a fingerprint and its
component, and is left out of the smallest id (null if there is no other); an empty
table gives no rows; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import stored
from strandline.llm.components import components

BITS = 64
DISTANCE = 3
SEED = 42
PIVOTS = 32
SMALL = 1024
WIDE = 128
CHUNK = 1024


def _pivots(n: int = PIVOTS):
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh64_intdigest(f"pivot {k}", SEED) for k in range(n)], dtype=np.uint64)


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint (unsigned) of one text."""
    import numpy as np
    import xxhash

    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()  # of bytes: A-Z only, and splits at the six ASCII separators
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(b" ".join(words[i : i + shingle]), SEED) for i in range(n - shingle + 1)], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``; ``fp`` is the fingerprint as a signed long."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint_of(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(n: int, distance: int = DISTANCE) -> list[int]:
    """Masks (unsigned) of the agreeing bits: two equal values within ``distance`` share at least one masked value."""
    blocks = 5
    while blocks < 8 and BITS * (blocks - distance) // blocks < max(1, n).bit_length() + 1:
        blocks += 1
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivoted(distinct: DataFrame) -> DataFrame:
    """``fp, coords``: the distances to all pivots."""
    away = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(p))))).cast("tinyint") for p in _pivots()]
    return distinct.select("fp", F.array(*away).alias("coords"))


def _linked(fp, table):
    """Sorted fingerprints and their coordinates → (member, least member that it reaches) of all that reach another."""
    import numpy as np

    i, j = np.triu_indices(len(fp), 1)
    for c in table.T:
        near = np.abs(c[i] - c[j]) <= DISTANCE
        i, j = i[near], j[near]
    near = np.bitwise_count(fp[i] ^ fp[j]) <= DISTANCE
    i, j = i[near], j[near]
    least = np.arange(len(fp))
    while True:
        now = least.copy()
        np.minimum.at(now, j, least[i])
        np.minimum.at(now, i, least[j])
        now = now[now]
        if (now == least).all():
            break
        least = now
    moved = least != np.arange(len(fp))
    return fp[moved], fp[least[moved]]


def _pairs_of_buckets(batches):
    """Buckets (arrays of distinct fingerprints with their coordinates) → links."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        us, vs = [], []
        column = b.column(0)
        for k in range(b.num_rows):
            members = column.slice(k, 1).flatten()
            fp = members.field("fp").to_numpy().view(np.uint64)
            table = members.field("coords").flatten().to_numpy().reshape(len(fp), -1)
            order = np.argsort(fp)
            u, v = _linked(fp[order], table[order])
            us.append(u)
            vs.append(v)
        u, v = (np.concatenate(x).view(np.int64) if x else np.array([], np.int64) for x in (us, vs))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _neighbours(batches):
    """(fp, varying bits) → values one or two of these bits away, and itself."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        for fp, mask in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            bits = np.array([1 << k for k in range(BITS) if mask >> k & 1], dtype=np.uint64)
            own = np.array([fp], dtype=np.int64).view(np.uint64)
            i, j = np.triu_indices(len(bits), 1)
            z = np.concatenate([own, own ^ bits, own ^ bits[i] ^ bits[j]])
            close = np.zeros(len(z), bool)
            close[: len(bits) + 1] = True
            yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)), pa.array(np.full(len(z), fp, np.int64)), pa.array(close)], names=["z", "fp", "close"])


def links(distinct: DataFrame, small: int = SMALL) -> DataFrame:
    """Distinct ``fp`` → ``u, v``: links that connect exactly what links at three bits or fewer connect."""
    masks = block_masks(distinct.count())
    known = stored(pivoted(distinct), "simhash-pivots")
    keyed = known.select("fp", "coords", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("block", "key"))
    size = keyed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying")).where(F.col("n") > 1)
    members = stored(keyed.join(stored(size, "simhash-buckets"), ["block", "key"]), "simhash-members")

    few = members.where(F.col("n") <= small).groupBy("block", "key").agg(F.collect_list(F.struct("fp", "coords")).alias("fps")).select("fps")
    pairs = few.mapInArrow(_pairs_of_buckets, "u long, v long")

    many = members.where(F.col("n") > small).groupBy("fp").agg(F.bit_or("varying").alias("mask"))
    around = stored(many.repartition("fp").mapInArrow(_neighbours, "z long, fp long, close boolean"), "simhash-around")
    meet = around.groupBy("z").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("v"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("v").isNotNull())
    met = around.join(stored(meet.select("z", "v"), "simhash-meet"), "z").select(F.col("fp").alias("u"), "v").where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE))
    return pairs.union(met).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, small: int = SMALL, **columns) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: the smallest id that links reach, its own included."""
    rows = stored(fingerprints(docs, shingle, **columns), "simhash-fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), small))
    placed = stored(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-placed")
    # stored, here and in links: a join of plain scans can be split where a component or a bucket fills much of the input
    least = stored(placed.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    named = stored(placed.join(least, "root").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def wide_fingerprint(text: str | None, memo, shingle: int = 5) -> tuple[int, int]:
    """Two signed halves of the fingerprint over the distinct shingles; a tie of a bit goes to the smallest shingle's."""
    import numpy as np

    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return 0, 0
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(h))
    with np.errstate(over="ignore"):
        x = np.full(len(h) - size + 1, size, np.uint64)
        for j in range(size):
            x = x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(x)]
        x = np.unique(_mixed(x))
        both = np.stack([_mixed(x), _mixed(x ^ np.uint64(0xD1B54A32D192ED03))], axis=1)
    ones = np.zeros(WIDE, np.int64)
    for k in range(0, len(both), 32768):
        ones += np.unpackbits(both[k : k + 32768].view(np.uint8).reshape(-1, WIDE // 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    first = np.unpackbits(both[0].view(np.uint8), bitorder="little")
    bits = np.where(2 * ones == len(both), first, 2 * ones > len(both))
    a, b = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)
    return int(a), int(b)


def _mixed(x):
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word → hash; forgotten when large, so memory is bounded."""

    def __missing__(self, word):
        import xxhash

        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def agreement(jaccard: float) -> float:
    """Share of bits in which fingerprints agree on average, by the angle between the shingle sets."""
    import math

    return 1 - math.acos(2 * jaccard / (1 + jaccard)) / math.pi


def table_masks(n: int, jaccard: float, recall: float = 0.95) -> list[tuple[int, int]]:
    """Sampled bits (signed masks of both halves) of the tables for ``n`` fingerprints.

    A bucket holds a few dozen by chance at any size of corpus; there are as many tables as
    let a pair of the given Jaccard similarity meet with probability ``recall``.
    """
    import math
    import random

    bits = max(8, math.ceil(math.log2(max(2, n))) - 6)
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agreement(jaccard) ** bits))
    rng = random.Random(bits)
    out = []
    for _ in range(tables):
        mask = sum(1 << k for k in rng.sample(range(WIDE), bits))
        out.append((_signed(mask & (1 << 64) - 1), _signed(mask >> 64)))
    return out


def _spanning(most: int):
    """Groups of (node, halves, side) → links that span what lies within ``most`` bits; those of side 0 are linked already."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            us, vs = [], []
            column = batch.column(0)
            edges = column.offsets.to_numpy() - column.offsets[0].as_py()
            fields = dict(zip(("node", "a", "b", "side"), column.flatten().flatten(), strict=True))
            fields = {k: v.to_numpy(zero_copy_only=False) for k, v in fields.items()}
            for low, high in zip(edges, edges[1:], strict=False):
                node = fields["node"][low:high]
                a, b = (fields[x][low:high].view(np.uint64) for x in "ab")
                side = fields["side"][low:high].astype(bool)
                if not side.any():
                    continue
                if len(node) <= 256:
                    near = np.bitwise_count(a[:, None] ^ a) + np.bitwise_count(b[:, None] ^ b) <= most
                    np.fill_diagonal(near, False)
                    if not near.any():
                        continue
                left = np.ones(len(node), bool)
                for start in range(len(node)):
                    if not left[start]:
                        continue
                    queue = [start] if side[start] else np.nonzero(~side)[0].tolist()
                    left[queue] = False
                    while queue:
                        i = queue.pop()
                        rest = np.nonzero(left)[0]
                        if not len(rest):
                            break
                        rest = rest[near[i, rest]] if len(node) <= 256 else rest[np.bitwise_count(a[rest] ^ a[i]) + np.bitwise_count(b[rest] ^ b[i]) <= most]
                        left[rest] = False
                        us.append(np.full(len(rest), node[i], np.int64))
                        vs.append(node[rest])
                        queue += rest.tolist()
            u, v = (np.concatenate(x) if x else np.array([], np.int64) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def wide_links(distinct: DataFrame, similarity: float = 0.8, jaccard: float = 0.8, recall: float = 0.95, chunk: int = CHUNK) -> DataFrame:
    """Distinct ``node, a, b`` → ``u, v``: links that connect what candidates with enough agreeing bits connect."""
    most = int((1 - similarity) * WIDE)
    masks = table_masks(distinct.count(), jaccard, recall)
    tables = F.array(*[F.xxhash64(F.lit(k), F.col("a").bitwiseAND(F.lit(x)), F.col("b").bitwiseAND(F.lit(y))) for k, (x, y) in enumerate(masks)])
    keyed = distinct.select("node", "a", "b", F.explode(tables).alias("key"))
    large = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk).select("key"), "wide-large")
    member = F.struct("node", "a", "b", F.lit(True).alias("side"))
    few = keyed.join(large, "key", "left_anti").groupBy("key").agg(F.collect_list(member).alias("rows")).where(F.size("rows") > 1)

    many = stored(keyed.join(large, "key"), "wide-members")
    hubs = stored(many.groupBy("key").agg(F.min(F.struct("node", "a", "b")).alias("hub")), "wide-hubs")
    bits = F.bit_count(F.col("a").bitwiseXOR(F.col("hub.a"))) + F.bit_count(F.col("b").bitwiseXOR(F.col("hub.b")))
    far = stored(many.join(hubs, "key").select("key", "node", "a", "b", F.col("hub.node").alias("hub"), (bits <= most).alias("near"), F.floor(bits / (most + 1)).cast("int").alias("ring")), "wide-rings")
    rings = far.groupBy("key", "ring").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("p")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("ring", "p"))).alias("pieces"))
    # within the distance two members' rings are the same or neighbours; those of ring 0 are linked through the hub
    of = lambda ring: F.coalesce(F.try_element_at("pieces", ring), F.lit(0))
    every = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<struct<ring:int,up:int,i:int,j:int>>"))
    task = lambda ring, up, i, j: F.struct(ring.alias("ring"), F.lit(up).alias("up"), i.alias("i"), j.alias("j"))
    ring = F.col("ring")
    placed = far.join(stored(rings, "wide-pieces"), "key").select("*", F.pmod(F.xxhash64("node"), of(ring)).cast("int").alias("own"))
    tasks = F.concat(
        F.when(ring > 0, every(of(ring), lambda j: task(ring, 0, F.least("own", j), F.greatest("own", j)))).otherwise(every(F.lit(0), lambda j: task(ring, 0, j, j))),
        every(of(ring + 1), lambda j: task(ring, 1, F.col("own"), j)),
        every(of(ring - 1), lambda j: task(ring - 1, 1, j, F.col("own"))),
    )
    spread = placed.select("key", "node", "a", "b", (ring > 0).alias("side"), F.explode(tasks).alias("task"))
    pieces = spread.groupBy("key", "task").agg(F.collect_list(F.struct("node", "a", "b", "side")).alias("rows"))
    groups = few.select("rows").union(pieces.select("rows"))
    direct = far.where(F.col("near") & (F.col("node") != F.col("hub"))).select(F.col("node").alias("u"), F.col("hub").alias("v"))
    return groups.mapInArrow(_spanning(most), "u long, v long").union(direct).distinct()


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, jaccard: float = 0.8, recall: float = 0.95, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, t, root`` of every row with an id: ``t`` is the hash of its text, ``root`` names its group."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        memo = _Words()
        for b in batches:
            halves = np.array([wide_fingerprint(t, memo, shingle) for t in b.column(2).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", "t", "a", "b"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    rows = rows.mapInArrow(run, f"doc_id {kind}, t long, a long, b long").select("doc_id", "t", F.xxhash64("a", "b").alias("node"), "a", "b")
    rows = stored(rows, "wide-fingerprints")
    distinct = stored(rows.groupBy("node").agg(F.min("a").alias("a"), F.min("b").alias("b")), "wide-distinct")
    roots = stored(components(wide_links(distinct, similarity, jaccard, recall, chunk)), "wide-roots")
    return rows.join(roots, "node", "left").select("doc_id", "t", F.coalesce("root", "node").alias("root"))
