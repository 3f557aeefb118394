"""Structured Streaming twins of the message-driven parts.

Each takes a streaming DataFrame and gives one, except where a sink is needed
(``foreachBatch``).  State is bounded by watermarks or timeouts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strandline.operators.control import BACKOFF, claim_one
from strandline.streaming.stateful import state_store


def deduplicate(events: DataFrame, keys: list[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """At-least-once delivery to once: repeats of a key within the watermark go."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def consume(messages: DataFrame, facts: DataFrame, key: str, ts: str, wanted: str, delay: str = "10 minutes") -> DataFrame:
    """Messages that are to be worked on: each key once, and only if the fact it speaks of still has the ``wanted`` state.

    ``facts``: ``key, state``, read anew for every batch.  Jobs and deletions are consumed alike.
    """
    return deduplicate(messages, [key], ts, delay).join(facts.where(F.col("state") == wanted).select(key), key, "left_semi")


def answer_events(answers: DataFrame, most: int = 2048) -> DataFrame:
    """``request_id, text, error`` → the events of each answer's stream in order: ``seq, event, data``.

    Start, progress, the text in pieces of at most ``most`` characters, and exactly one of
    done and error; an answer with an error shows what came before it.
    """
    n = F.ceil(F.length("text") / most).cast("int")
    pieces = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(F.col("text"), (i - 1) * most + 1, F.lit(most)))).otherwise(F.array().cast("array<string>"))
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.cast("string").alias("data"))
    last = F.when(F.col("error").isNull(), event("done", F.length("text"))).otherwise(event("error", F.col("error")))
    line = F.concat(F.array(event("start", F.lit("")), event("progress", F.lit("GENERATING"))), F.transform(pieces, lambda p: event("delta", p)), F.array(last))
    return answers.select("request_id", F.posexplode(line).alias("seq", "e")).select("request_id", "seq", "e.event", "e.data")


def windowed_counts(events: DataFrame, ts: str, by: str, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by tumbling or sliding event-time window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = events.withWatermark(ts, delay).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Lease heartbeats as sessions: a lease ends when no beat comes for ``gap``."""
    w = F.session_window(ts, gap)
    grouped = events.withWatermark(ts, delay).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("beats"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "beats")


def retry_step(failures: DataFrame) -> DataFrame:
    """``job_id, attempt, failed_at, retryable`` → the next due time, or the dead-letter queue after the last step."""
    n = F.col("attempt")
    dead = ~F.col("retryable") | (n > 3)
    delay = F.element_at(F.array(F.lit(5), F.lit(30), F.lit(300)), F.least(F.greatest(n, F.lit(1)), F.lit(3)).cast("int"))
    due = F.when(~dead, F.timestamp_seconds(F.unix_seconds("failed_at") + delay))
    return failures.select("job_id", "attempt", F.when(dead, "DEAD_LETTER").otherwise("RETRY").alias("route"), due.alias("due_at"))


def first_terminal(events: DataFrame, ts: str) -> DataFrame:
    """Exactly one terminal event a request, whenever it comes: the first of done, error, cancelled.

    The state is one event for each request that has ended; run it in complete or update mode.
    """
    ended = events.where(F.col("event").isin("done", "error", "cancelled"))
    return ended.groupBy("request_id").agg(F.min_by("event", F.struct(F.col(ts), "event")).alias("terminal"))


STATE = "at long, done long, fingerprint string, context string"
CLAIMS = "key string, seq long, outcome string"


class Claims(StatefulProcessor):
    """Claims of a key → their outcomes; the state is the last claim that holds."""

    def __init__(self, running_ttl: int, result_ttl: int, expire: bool):
        self.ttls, self.expire = (running_ttl, result_ttl), expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", STATE, 1000 * sum(self.ttls) if self.expire else None)

    def handleInputRows(self, key, rows, timerValues):
        found = self.held.get()
        now = None if found is None else tuple(found)
        for r in sorted(rows, key=lambda r: r["seq"]):
            outcome, now = claim_one(now, r["at"], r["done_at"], r["fingerprint"], r["context"], *self.ttls)
            yield Row(key=key[0], seq=r["seq"], outcome=outcome)
        self.held.update(tuple(now))

    def close(self) -> None:
        pass


def idempotency(events: DataFrame, running_ttl: int = 600, result_ttl: int = 300, expire: bool = True) -> DataFrame:
    """Streaming claims (``key, seq, at, done_at, fingerprint, context``); a key's state expires by processing time.

    ``expire`` False keeps state, for runs over what is there (an expiring state
    never lets such a run end).  Keys with few rows are most, so rows come
    one by one and not as a frame for each key.  Needs the RocksDB state store, which is set for the session.
    """
    state_store(events.sparkSession)
    return events.groupBy("key").transformWithState(Claims(running_ttl, result_ttl, expire), CLAIMS, "append", "processingtime" if expire else "none")


def outbox_publisher(queue: DataFrame, publish, batch: int = 50):
    """Poll a queue in micro-batches of ``batch`` files; ``publish`` gets each batch and its number, and must be idempotent."""
    return queue.writeStream.foreachBatch(lambda df, n: publish(df.where("state = 'PENDING'"), n)).outputMode("append")


def backoff_ladder() -> list[int]:
    return list(BACKOFF)
