"""Keyed state with timers: retries that become due, and leases that end by themselves.

Both are ``transformWithState`` processors in event time: a timer fires when the watermark has passed it, so
a replay of the same messages gives the same rows.  State is a few numbers for each key.  They need the RocksDB state store
(``state_store`` sets it for the session).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds before the first, second and third retry.
STEPS = (5, 30, 300)
LEASE_SECONDS = 900


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Retries(StatefulProcessor):
    """Failures of a job → ``RETRY`` rows when they become due, ``DEAD_LETTER`` rows at once."""

    def __init__(self, steps=STEPS):
        self.steps = steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: Retries so far; more than the steps once the job is dead.
        self.count = handle.getValueState("count", "n int")
        self.due = handle.getMapState("due", "at long", "attempt int")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        rows = pd.concat(list(rows)).sort_values(["at", "seq"])
        n = self.count.get()[0] if self.count.exists() else 0
        dead = []
        for at, retryable in zip(rows["at"].tolist(), rows["retryable"].tolist(), strict=True):
            if retryable and n < len(self.steps):
                due = int(at) + self.steps[n]
                n += 1
                self.due.updateValue((due,), (n,))
                self.handle.registerTimer(due * 1000)
            else:
                dead.append((key[0], min(n, len(self.steps)) + 1, "DEAD_LETTER", int(at)))
                n = len(self.steps)
        self.count.update((n,))
        if dead:
            yield pd.DataFrame(dead, columns=["job_id", "attempt", "route", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        due = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if self.due.containsKey((due,)):
            attempt = self.due.getValue((due,))[0]
            self.due.removeKey((due,))
            yield pd.DataFrame([(key[0], attempt, "RETRY", due)], columns=["job_id", "attempt", "route", "at"])

    def close(self) -> None:
        pass


def retries(failures: DataFrame, delay: str, steps=STEPS) -> DataFrame:
    """A stream of ``job_id, seq, failed_at, retryable`` → ``job_id, attempt, route, at`` (seconds).

    The n-th retryable failure of a job is retried after the n-th step; the row comes when that is due.
    A failure beyond the steps, or one that cannot be retried, is a dead letter, and so is all that follows.
    Two retries of a job that are due in the same second are one.  ``delay``: how late failures may come.
    """
    state_store(failures.sparkSession)
    kind = failures.schema["job_id"].dataType.simpleString()
    rows = failures.withWatermark("failed_at", delay).select("job_id", "seq", "failed_at", F.unix_seconds("failed_at").alias("at"), "retryable")
    return rows.groupBy("job_id").transformWithStateInPandas(Retries(steps), f"job_id {kind}, attempt int, route string, at long", "append", "eventtime")


def lease_step(state: tuple | None, at: int, owner: str, claim: bool, lease: int):
    """(owner, fence, end) and one message → the state after it, its outcome, and whether the lease before had ended.

    A claim is granted where no lease runs, with the next fencing number; a beat extends the lease of its
    owner while it runs.  All else is refused, a former owner's beat too.
    """
    ended = state is not None and state[0] is not None and at >= state[2]
    fence = state[1] if state else 0
    if ended or state is None:
        state = (None, fence, 0)
    if claim and state[0] is None:
        return (owner, fence + 1, at + lease), "GRANTED", ended
    if not claim and state[0] == owner:
        return (owner, fence, at + lease), "EXTENDED", ended
    return state, "REFUSED", ended


class Leases(StatefulProcessor):
    """Claims and beats of a resource → an outcome for each, and ``EXPIRED`` when a lease ends."""

    def __init__(self, lease: int = LEASE_SECONDS):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "owner string, fence long, ends long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        rows = pd.concat(list(rows)).sort_values(["at", "seq"])
        state, out = tuple(self.held.get()) if self.held.exists() else None, []
        timer = state[2] if state and state[0] is not None else None
        for seq, at, owner, claim in zip(rows["seq"].tolist(), rows["at"].tolist(), rows["owner"].tolist(), rows["claim"].tolist(), strict=True):
            before = state
            state, outcome, ended = lease_step(state, int(at), owner, bool(claim), self.lease)
            if ended:
                out.append((key[0], None, before[0], "EXPIRED", before[1], before[2]))
            out.append((key[0], int(seq), owner, outcome, state[1], int(at)))
        now = state[2] if state[0] is not None else None
        if timer != now:
            if timer is not None:
                self.handle.deleteTimer(timer * 1000)
            if now is not None:
                self.handle.registerTimer(now * 1000)
        self.held.update(state)
        yield pd.DataFrame(out, columns=["resource", "seq", "owner", "outcome", "fence", "at"]).astype({"seq": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        owner, fence, ends = self.held.get()
        if owner is not None and ends * 1000 == expiredTimerInfo.getExpiryTimeInMs():
            self.held.update((None, fence, 0))
            yield pd.DataFrame([(key[0], None, owner, "EXPIRED", fence, ends)], columns=["resource", "seq", "owner", "outcome", "fence", "at"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def leases(messages: DataFrame, delay: str, lease: int = LEASE_SECONDS) -> DataFrame:
    """A stream of ``resource, seq, sent_at, owner, claim`` → ``resource, seq, owner, outcome, fence, at`` (seconds).

    ``outcome``: GRANTED, EXTENDED or REFUSED for each message, with the fencing number that holds after it; EXPIRED (without
    ``seq``) once for each lease that ended, at the end that its last beat gave it.
    """
    state_store(messages.sparkSession)
    kind = messages.schema["resource"].dataType.simpleString()
    rows = messages.withWatermark("sent_at", delay).select("resource", "seq", "sent_at", F.unix_seconds("sent_at").alias("at"), "owner", "claim")
    return rows.groupBy("resource").transformWithStateInPandas(Leases(lease), f"resource {kind}, seq long, owner string, outcome string, fence long, at long", "append", "eventtime")
