"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

Every document goes to a group drawn by a seeded generator, not by any of its values, so
neither a hot source nor a row that fills a third of the table makes a large group.
Groups are about ``group_docs`` documents, and fewer where these are long: their number
follows from the table's rows and bytes.  One shuffle brings a group together; its task
encodes the texts and packs it alone, so memory is one group.

Within a group a document longer than a sequence first gives whole sequences.  What is
left of it (or all of a shorter one) is one item.  Items are placed in decreasing order,
each into the first sequence with room for it; a tournament tree, whose inner nodes hold
the most room below them, finds that sequence in a logarithm of their number.  Then
the gaps that remain are closed: the emptiest sequences are taken apart and cut to the
gaps of the others, and the one sequence that is left at last is cut at powers of two,
which need no padding.  So only a few items of a group are cut, and nothing is padded.

Ids are those of the ``tokenizers`` library for the vocabulary's .json file.  They are made with
``tiktoken`` from the same vocabulary as ranks, which gives the same ids (the tests compare all code points, and
texts) at a fifth of the time; a text that it refuses goes through ``tokenizers``.

Defined results: a null text is the empty one, whose only id is the end mark; repeated
rows are packed each; a null id stays null; an empty table gives no rows; extra columns
are ignored.  The same table, read in the same splits, gives the same sequences.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
END = 1
GROUP_DOCS = 1024
GROUP_BYTES = 8 << 20
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str, pattern: str):
    """text → array of unsigned 32-bit ids."""
    import base64

    import numpy as np
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    exact = Tokenizer.from_file(json_path)
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: exact.token_to_id(SPECIAL)})

    def encode(text: str):
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except Exception:  # its regular expressions give up on some very long runs
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def first_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Positions of ``sizes`` (each from 1 to ``room``) by bin: decreasing, ties by position, each into the first bin with room."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    most = [room] * (2 * leaves)
    bins: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        need, node = sizes[k], 1
        while node < leaves:
            node *= 2
            if most[node] < need:
                node += 1
        if node - leaves == len(bins):
            bins.append([])
        bins[node - leaves].append(k)
        most[node] -= need
        while node > 1:
            node //= 2
            most[node] = max(most[2 * node], most[2 * node + 1])
    return bins


def close_gaps(bins: list[list[tuple]], room: int) -> list[list[tuple]]:
    """Bins of (document, start, length), all full but one: the emptiest bins' pieces, cut where need be, go into the others' gaps."""
    held = [sum(p[2] for p in b) for b in bins]
    done = [b for b, n in zip(bins, held, strict=True) if n == room]
    open_ = [b for n, b in sorted((x for x in zip(held, bins, strict=True) if x[0] < room), key=lambda x: -x[0])]
    at, last = 0, len(open_) - 1
    gap = room - sum(p[2] for p in open_[0]) if open_ else 0
    while at < last:
        doc, start, n = open_[last].pop()
        take = min(n, gap)
        open_[at].append((doc, start + n - take, take))
        if take < n:
            open_[last].append((doc, start, n - take))
        if not open_[last]:
            last -= 1
        gap -= take
        if not gap:
            at += 1
            gap = room - sum(p[2] for p in open_[at])
    return done + open_[: last + 1]


def cut_at_powers(pieces: list[tuple]) -> list[list[tuple]]:
    """One sequence as several, each as long as a power of two."""
    left, out = list(reversed(pieces)), []
    rest = sum(p[2] for p in pieces)
    while rest:
        size = 1 << (rest.bit_length() - 1)
        rest -= size
        own: list[tuple] = []
        while size:
            doc, start, n = left.pop()
            take = min(n, size)
            own.append((doc, start, take))
            if take < n:
                left.append((doc, start + take, n - take))
            size -= take
        out.append(own)
    return out


def layout(totals: list[int], room: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Ids of each document → (document, start, length, sequence, offset) of every piece."""
    items = [(d, n - n % room, n % room) for d, n in enumerate(totals) if n % room]
    bins = [[(d, s, room)] for d, n in enumerate(totals) for s in range(0, n - n % room, room)]
    packed = close_gaps([[items[k] for k in b] for b in first_fit([x[2] for x in items], room)], room) if items else []
    for b in packed:
        bins += [b] if sum(p[2] for p in b) == room else cut_at_powers(b)
    out = []
    for k, b in enumerate(bins):
        offset = 0
        for doc, start, n in b:
            out.append((doc, start, n, k, offset))
            offset += n
    return out


def pack(docs: DataFrame, encoder_of, length: int = LENGTH, end: int = END, group_docs: int = GROUP_DOCS, group_bytes: int = GROUP_BYTES, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of every piece.

    ``encoder_of()`` gives, on whichever machine it runs, the function from a text to its
    ids; ``end`` follows each document.  ``ids`` are the piece's, unsigned little-endian 32-bit.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    groups = max(1, -(-size["n"] // group_docs), -(-size["b"] // group_bytes))
    grouped = texts.select("doc_id", "text", F.floor(F.rand(seed) * groups).cast("long").alias("group"))

    def run(table):
        import numpy as np
        import pyarrow as pa

        encode = encoder_of()
        stop = np.array([end], dtype=np.uint32)
        ids = [np.concatenate([encode(x.as_py()), stop]).astype("<u4") for x in table.column("text")]
        pieces = layout([len(x) for x in ids], length)
        doc, start, n, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
        first = table.column("group")[0].as_py() << 32
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(pa.array(doc)),
                "start": start,
                "length": n,
                "ids": pa.array([ids[d][s : s + k].tobytes() for d, s, k, _, _ in pieces], pa.binary()),
                "doc_tokens": np.array([len(ids[d]) for d in doc.tolist()], dtype=np.int64),
                "sequence_id": sequence + first,
                "offset": offset,
            }
        )

    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return grouped.groupBy("group").applyInArrow(run, schema)
