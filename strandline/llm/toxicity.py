"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes what is done to hide a word: compatibility forms (NFKC), case,
zero-width characters, look-alike letters of other scripts, and digits or signs
that stand for letters.  Accented Latin letters stay, they are letters of their own.

Lexicon entries are beginnings of words (``SHORTEST`` to ``LONGEST`` letters) and whole shorter words.  ``learn`` finds them in labelled rows:
beginnings that many toxic texts share (after removing near copies, which would
make any of their words look telling) and that clean texts lack, weighted by
log-odds.  The built-in list joins what is learned where clean texts lack it.  Forms of a word that begin like an entry but occur in clean texts alone
become exception phrases, which take their place in the automaton and cancel what
they cover.  A score is a logistic function of the matched weight per word and of
the number of matches; its coefficients are fitted on the same labelled rows.

Bound: the labelled rows are a sample, chosen by a hash of the id, of about
``max_rows`` rows; of near copies among them the one with the smallest id counts.  All
that they show enters the model, so its size has the same bound.  Scoring is one pass over whole texts in Arrow
batches, linear in a text's length.

Defined results: null or empty texts have no matches and get the score of a text
without any; rows with a null id are scored and never learned from; several labels
of an id count as toxic if one is; without a toxic or without a clean labelled row
the built-in list decides; repeated rows give repeated results, an empty table none.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Look-alike letters and what they look like.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝвкмтнгαορνικτυεηγ", "aeopcyxijshdqwbkmthraopviktueny", strict=True))
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: A small general list, used where there are no labels.
DEFAULT_LEXICON = {w: 3.0 for w in ("idiot", "moron", "stupid", "scum", "pathetic", "worthless", "loser", "imbecile", "disgusting", "bastard")}
SEPARATORS = ".,;:?\"'()[]{}<>«»“”„‘’¡¿-_*#%&/|~=+\\"
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"

_TABLE = {ord(k): v for k, v in {**HOMOGLYPHS, **SUBSTITUTES}.items()} | {ord(c): " " for c in SEPARATORS} | {ord(c): None for c in INVISIBLE}
_MARKS = re.compile("[\u0300-\u036f]+")
SHORTEST, LONGEST = 4, 9


def fold(text: str | None) -> list[str]:
    """Folded words of a text."""
    text = text or ""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _MARKS.sub("", text)
    return text.lower().translate(_TABLE).split()


@dataclass(frozen=True)
class Model:
    """``lexicon``: beginnings of folded words; ``exceptions``: folded phrases; ``coefficients``: bias, weight per word, log of matches."""

    lexicon: dict = field(default_factory=lambda: dict(DEFAULT_LEXICON))
    exceptions: frozenset = frozenset()
    coefficients: tuple = (-3.0, 10.0, 1.5)


def matcher(model: Model):
    """text → (matched weight, matches, words, matched words)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for stem, weight in model.lexicon.items():
        found.add_word(" " + stem, (len(stem) + 1, weight))
    for phrase in model.exceptions:
        folded = " ".join(fold(phrase))
        found.add_word(f" {folded} ", (len(folded) + 2, None))
    found.make_automaton()

    def run(text):
        words = fold(text)
        line = f" {' '.join(words)} "
        best: dict[int, tuple] = {}
        covered = []
        for end, (size, weight) in found.iter(line) if len(found) else ():
            start = end - size + 1
            if weight is None:
                covered.append((start, end))
            if start not in best or best[start][0] < size:
                best[start] = (size, weight)
        hits, end, k = [], 0, 0
        covered.sort()
        for s in sorted(best):
            while k < len(covered) and covered[k][0] <= s:
                end = max(end, covered[k][1])
                k += 1
            if s >= end and best[s][1] is not None:
                hits.append((s, best[s][1]))
        return sum(w for _, w in hits), len(hits), len(words), sorted({line[s + 1 : line.index(" ", s + 1)] for s, _ in hits})

    return run


def probability(model: Model, weight: float, hits: int, words: int) -> float:
    b, per_word, count = model.coefficients
    z = b + per_word * weight / (words + 10) + count * math.log1p(hits)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, hits, n_words``: one row for each row of ``docs``."""

    def run(batches):
        import pyarrow as pa

        match = matcher(model)
        for b in batches:
            found = [match(t)[:3] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([probability(model, *x) for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())],
                names=["doc_id", "score", "hits", "n_words"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, hits long, n_words long")


def held_out(id_col: str = "doc_id"):
    """Whether a row's labels must not be learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``id, toxic, text`` of the sample; the sample's ids (``max_rows`` or a little more) are small enough to send to every task."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    share = min(1.0, max_rows / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64(F.col("id")), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")


def _signature(words: list[str]) -> int:
    """Smallest hash of the text's shingles: near copies nearly always share it."""
    import xxhash

    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))), default=0) >> 1


def _beginnings(words: list[str]) -> set[str]:
    return {w[:k] for w in set(words) for k in range(SHORTEST, min(len(w), LONGEST) + 1)} | {w + " " for w in words if 1 < len(w) < SHORTEST}


def _count_beginnings(among: frozenset | None):
    def run(batches):
        from collections import Counter

        import pyarrow as pa

        n = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                stems = _beginnings(fold(t))
                n.update(stems if among is None else stems & among)
        for k in range(0, len(keys := list(n)), 50_000):
            part = keys[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([n[x] for x in part], pa.int64())], names=["stem", "n"])

    return run


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, exceptions: tuple = (), **columns) -> Model:
    """Fit lexicon, exception phrases and coefficients on the labelled sample."""
    from strandline.llm.common import stored

    def sign(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([_signature(fold(t)) for t in b.column(2).to_pylist()], pa.int64())], names=["id", "toxic", "text", "sig"])

    sample = training_rows(docs, labels, max_rows, **columns)
    signed = sample.select(F.col("id").cast("string").alias("id"), "toxic", "text").mapInArrow(sign, "id string, toxic int, text string, sig long")
    rows = stored(signed.groupBy("toxic", "sig").agg(F.min(F.struct("id", "text")).alias("x")).select("toxic", "x.text"), "toxicity-sample")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(exceptions=frozenset(exceptions))

    def counts(toxic: int, among):
        found = rows.where(F.col("toxic") == toxic).select("text").mapInArrow(_count_beginnings(among), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
        return found

    support = max(2, math.ceil(0.003 * n1), min(4, math.ceil(0.1 * n1)))
    known = {w[:LONGEST]: v for w, v in DEFAULT_LEXICON.items()}
    usual = {r["stem"]: r["n"] for r in counts(1, None).where(F.col("n") >= support).orderBy("stem").collect()}
    clean = {r["stem"]: r["n"] for r in counts(0, frozenset(usual) | frozenset(known)).collect()}
    weight = {s: math.log((n + 0.5) / (n1 + 1)) - math.log((clean.get(s, 0) + 0.5) / (n0 + 1)) for s, n in usual.items()}
    telling = {s: w for s, w in weight.items() if w >= math.log(8)}
    lexicon = _prune(telling | {s: w for s, w in known.items() if s not in telling and not clean.get(s)}, known | usual)

    learned = Model(lexicon=lexicon, exceptions=frozenset(exceptions))

    def measure(batches):
        import pyarrow as pa

        match = matcher(learned)
        for b in batches:
            found = [match(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[3] for x in found], pa.list_(pa.string()))],
                names=["toxic", "weight", "hits", "words", "forms"],
            )

    seen = rows.select("toxic", "text").mapInArrow(measure, "toxic int, weight double, hits long, words long, forms array<string>").collect()
    forms: dict[int, dict] = {0: {}, 1: {}}
    for r in seen:
        for f in r["forms"]:
            forms[r["toxic"]][f] = forms[r["toxic"]].get(f, 0) + 1
    harmless = {f for f, n in forms[0].items() if n >= 2 and f not in forms[1]}
    return Model(lexicon, frozenset(exceptions) | harmless, _fit([(r["toxic"], r["weight"], r["hits"], r["words"]) for r in seen]))


def _prune(telling: dict, n: dict) -> dict:
    """Of beginnings of one another: the shorter one, unless a longer one is much more telling and covers most of its texts."""
    kept: dict[str, float] = {}
    better: set[str] = set()
    for s, w in telling.items():
        for k in range(SHORTEST, len(s)):
            p = s[:k]
            if p in telling and w > telling[p] + 0.7 and n[s] >= 0.5 * n[p]:
                better.add(p)
    for s in sorted(telling, key=lambda s: (len(s), s)):
        if s not in better and not any(s[:k] in kept for k in range(SHORTEST, len(s))):
            kept[s] = telling[s]
    return kept


def _fit(rows, rounds: int = 40, ridge: float = 1e-3) -> tuple:
    """Coefficients of the logistic regression by Newton steps."""
    import numpy as np

    y = np.array([r[0] for r in rows], float)
    x = np.array([[1.0, w / (n + 10), math.log1p(h)] for _, w, h, n in rows])
    c = np.zeros(3)
    penalty = ridge * len(y) * np.array([1e-3, 1e-2, 1.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * c)
        c = c + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in c)
