"""Optimistic mutation streams: commands run at once, wait for the server's verdicts, and are confirmed or rolled back.

A stream is an ordered lane of commands. Answers may come in any order and are buffered; a stream settles when, in order, either a
reject is reached (the whole stream is rolled back) or all are confirmed (the optimistic changes are undone backwards and the
server's are applied, as one Z-set). fold() is the same rule over tables of any size.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.operators.delta import ZSet, apply_zset
from brindle.session import settled, shared_folder
from brindle.sources.catalog import Catalog
from brindle.streaming.reactive import Registry

Command = Callable[[Catalog], ZSet]


@dataclass
class Verdict:
    """changes: the server's; None with a reason if rejected."""

    changes: ZSet | None = None
    reason: str | None = None


@dataclass
class Lane:
    next_seq: int = 1
    pending: dict[int, ZSet] = field(default_factory=dict)
    answers: dict[int, Verdict] = field(default_factory=dict)


def state_of(pending: list[int], answers: dict[int, bool]) -> str:
    """pending in order; answers: seq to confirmed. wait, rejected or confirmed."""
    for seq in pending:
        if seq not in answers:
            return "wait"
        if not answers[seq]:
            return "rejected"
    return "confirmed"


class SyncClient:
    def __init__(self, registry: Registry):
        self.registry, self.catalog = registry, registry.catalog
        self.lanes: dict[int, Lane] = {}
        self._ids = itertools.count(1)

    def create_stream(self) -> int:
        stream = next(self._ids)
        self.lanes[stream] = Lane()
        return stream

    def execute(self, stream: int, command: Command) -> tuple[int, ZSet]:
        """Runs the command on the local tables; (sequence number, its changes) to be sent."""
        lane = self.lanes[stream]
        changes = command(self.catalog).map(settled)  # the log of pending changes; later plans read it, not what it was made of
        seq, lane.next_seq = lane.next_seq, lane.next_seq + 1
        lane.pending[seq] = changes
        self.registry.notify(changes)
        return seq, changes

    def execute_blocking(self, command: Command, server) -> str:
        """A stream of one command."""
        stream = self.create_stream()
        seq, changes = self.execute(stream, command)
        return self.receive(stream, seq, server.handle(changes))

    def receive(self, stream: int, seq: int, verdict: Verdict) -> str:
        """The stream's state after this answer: wait, confirmed or rejected."""
        lane = self.lanes[stream]
        if seq not in lane.pending:
            return "wait"
        lane.answers[seq] = verdict
        order = sorted(lane.pending)
        state = state_of(order, {s: v.reason is None for s, v in lane.answers.items()})
        if state == "wait":
            return state
        undo = ZSet()
        for s in reversed(order):
            undo = undo.extend(lane.pending[s].invert(backwards=True))
        if state == "confirmed":
            for s in order:
                undo = undo.extend(lane.answers[s].changes or ZSet())
        lane.pending.clear()
        lane.answers.clear()
        apply_zset(self.catalog, undo)
        self.registry.notify(undo)
        return state


class EchoServer:
    """Applies each client's changes to its own tables and sends them back; what validate objects to is rejected."""

    def __init__(self, catalog: Catalog, validate: Callable[[Catalog, ZSet], str | None] = lambda catalog, changes: None):
        self.catalog, self.validate = catalog, validate

    def handle(self, changes: ZSet) -> Verdict:
        if reason := self.validate(self.catalog, changes):
            return Verdict(reason=reason)
        apply_zset(self.catalog, changes)
        return Verdict(changes)

    def handle_batch(self, batch: list[ZSet]) -> list[Verdict]:
        """All or nothing: after the first reject the tables are as before and the others are rejected too."""
        before, out = self.catalog.copy(), []
        for changes in batch:
            out.append(self.handle(changes))
            if out[-1].reason:
                self.catalog.replace_tables(before)
                return [v if v.reason else Verdict(reason="batch aborted") for v in out] + [Verdict(reason="batch aborted")] * (len(batch) - len(out))
        return out


@dataclass
class Batcher:
    """Sends a stream's commands in batches, one in flight: at count, when the oldest has waited wait_ms (see tick), or when flush is called; failures are retried."""

    client: SyncClient
    server: EchoServer
    stream: int
    count: int = 1
    retries: int = 0
    wait_ms: int | None = None
    waiting: list[tuple[int, ZSet]] = field(default_factory=list)
    since: float = 0.0
    clock: Callable[[], float] = time.monotonic

    def execute(self, command: Command) -> str:
        if not self.waiting:
            self.since = self.clock()
        self.waiting.append(self.client.execute(self.stream, command))
        return self.flush() if len(self.waiting) >= self.count else self.tick()

    def tick(self) -> str:
        """Sends what has waited long enough; to be called by the host's timer."""
        due = self.wait_ms is not None and self.waiting and (self.clock() - self.since) * 1000 >= self.wait_ms
        return self.flush() if due else "wait"

    def flush(self) -> str:
        if not self.waiting:
            return "wait"
        sent, self.waiting, state = self.waiting, [], "wait"
        for attempt in range(self.retries + 1):
            try:
                verdicts = self.server.handle_batch([c for _, c in sent])
                break
            except ConnectionError:
                if attempt == self.retries:
                    self.waiting = sent
                    raise
        for (seq, _), verdict in zip(sent, verdicts, strict=True):
            state = self.client.receive(self.stream, seq, verdict)
        return state


def fold(pending: DataFrame, answers: DataFrame) -> DataFrame:
    """pending (stream_id, seq_no), answers (stream_id, seq_no, confirmed): (stream_id, pending, state) for each stream."""
    said = answers.groupBy("stream_id", "seq_no").agg(F.max("confirmed").alias("confirmed"))
    both = pending.join(said, ["stream_id", "seq_no"], "left")
    missing, rejected = F.min(F.when(F.col("confirmed").isNull(), F.col("seq_no"))), F.min(F.when(~F.col("confirmed"), F.col("seq_no")))
    ends = both.groupBy("stream_id").agg(F.count("*").alias("pending"), missing.alias("missing"), rejected.alias("rejected"))
    state = F.when(F.col("rejected").isNotNull() & (F.col("missing").isNull() | (F.col("rejected") < F.col("missing"))), "rejected").when(F.col("missing").isNotNull(), "wait").otherwise("confirmed")
    return ends.select("stream_id", "pending", state.alias("state"))


def settle(log: DataFrame) -> DataFrame:
    """fold() over a streaming log (stream_id, seq_no, kind: sent, confirmed or rejected): (stream_id, pending, state) whenever a stream settles.

    What a stream still waits for is its state, so the state grows with open commands only. Answers may come before the log says
    that the command was sent, as the order within a micro-batch isn't kept; repeated rows change nothing.
    """

    def one(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sent, said, good = (list(x) for x in state.get) if state.exists else ([], [], [])
        pending, answers = set(sent), dict(zip(said, good, strict=True))
        for frame in frames:
            for seq, kind in zip(frame["seq_no"].tolist(), frame["kind"], strict=True):
                if kind == "sent":
                    pending.add(seq)
                else:
                    answers[seq] = kind == "confirmed"
        found = state_of(sorted(pending), answers) if pending and answers else "wait"
        if found == "wait":
            state.update((sorted(pending), list(answers), list(answers.values())))
            return
        state.remove()
        yield pd.DataFrame({"stream_id": [key[0]], "pending": [len(pending)], "state": [found]})

    held = "sent array<long>, said array<long>, good array<boolean>"
    return log.groupBy("stream_id").applyInPandasWithState(one, "stream_id long, pending long, state string", held, "append", GroupStateTimeout.NoTimeout)


def latest_image(feed: DataFrame, key: str, seq: str, deleted: str) -> DataFrame:
    """The last row of each key of an upsert feed; keys whose last row is a delete are gone."""
    rest = [c for c in feed.columns if c != key]
    last = feed.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__r"))
    return last.select(key, "__r.*").where(f"NOT ({deleted})")


def maintain(feed: DataFrame, path: str, key: str, seq: str, deleted: str, checkpoint: str, buckets: int = 64, **trigger):
    """A streaming query that keeps the latest row of each key of a change feed under path, in folders by the key's bucket.

    A micro-batch rewrites the buckets it touches and no other. Rows of deleted keys stay (a late, older change must not bring them
    back): readers leave out what meets `deleted`, as image() does. A batch that is repeated after a failure gives the same rows.
    """
    spark = feed.sparkSession
    names = feed.columns
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = lambda: where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    stored = T.StructType([*feed.schema.fields, T.StructField("__bucket", T.IntegerType())])

    def batch(df: DataFrame, epoch: int) -> None:
        every = df.withColumn("__bucket", F.pmod(F.hash(key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in every.select("__bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return
        if there():
            every = spark.read.schema(stored).parquet(path).where(F.col("__bucket").isin(touched)).unionByName(every)
        with shared_folder(spark, "image") as folder:  # written whole before the buckets it was read from are replaced
            latest_image(every, key, seq, "false").select(*names, "__bucket").write.parquet(folder)
            new = spark.read.schema(stored).parquet(folder).repartition("__bucket")
            new.write.partitionBy("__bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def image(spark: SparkSession, path: str, deleted: str) -> DataFrame:
    """What maintain() keeps, without deleted keys."""
    return spark.read.parquet(path).drop("__bucket").where(f"NOT coalesce({deleted}, false)")
