"""Stateful streams: a rolling budget with refusals, and results upserted batch by batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from inkwarden.operators.posts import upsert

HOUR = 3600


class Budget:
    """Grants whole requests while what was granted in the last ``span`` seconds stays within ``limit``.

    A refused request costs nothing. A grant of exactly ``span`` ago no longer counts.
    """

    def __init__(self, limit: int, span: float = HOUR, held: list[tuple[float, int]] | None = None):
        self.limit, self.span, self.held = limit, span, deque(held or [])

    def reserve(self, now: float, n: int) -> bool:
        while self.held and self.held[0][0] <= now - self.span:
            self.held.popleft()
        granted = sum(k for _, k in self.held) + n <= self.limit
        if granted:
            self.held.append((now, n))
        return granted


def _folded(limit: int, span: float):
    """Grants over a stream sorted by owner and time: what an owner was granted in the last span is all that is kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, budget = object(), Budget(limit, span)
        for rows in frames:
            granted = []
            for owner, at, n in zip(rows["owner"], rows["at"], rows["n"], strict=True):
                if owner != now:
                    now, budget = owner, Budget(limit, span)
                granted.append(budget.reserve(at, int(n)))
            yield rows.assign(granted=granted)

    return run


def _granted(budget: Budget, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["at", "request"], kind="stable")
    return rows.assign(granted=[budget.reserve(t, int(n)) for t, n in zip(rows["at"], rows["n"], strict=True)])


REQUESTS = "owner string, request long, at double, n long, granted boolean"


def greedy(requests: DataFrame, limit: int, span: float = HOUR) -> DataFrame:
    """``requests`` (owner, request, at in seconds, n) with ``granted``, each owner in order of time.

    An owner's requests stream by in order of time, sorted on disk where they are
    many; memory holds the grants of the last span alone, which ``limit`` bounds.
    """
    ordered = requests.select("owner", "request", "at", "n").repartition("owner").sortWithinPartitions("owner", "at", "request")
    return ordered.mapInPandas(_folded(limit, span), REQUESTS)


def greedy_stream(requests: DataFrame, limit: int, span: float = HOUR) -> DataFrame:
    """``greedy`` over a stream: an owner's grants of the last span are its state, dropped when they have run out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        budget = Budget(limit, span, list(zip(*state.get, strict=True)) if state.exists else None)
        rows = pd.concat(list(batches))
        out = _granted(budget, rows)
        state.update(([t for t, _ in budget.held], [n for _, n in budget.held]))
        state.setTimeoutDuration(int(span * 1000))
        yield out[["owner", "request", "at", "n", "granted"]]

    return requests.groupBy("owner").applyInPandasWithState(step, REQUESTS, "at array<double>, n array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def rolling_usage(events: DataFrame, by: str, ts: str = "ts", span: str = "INTERVAL 1 HOUR") -> DataFrame:
    """``events`` with the events of the last hour, by key."""
    window = Window.partitionBy(by).orderBy(F.col(ts).cast("timestamp").cast("double")).rangeBetween(-HOUR, 0)
    return events.withColumn("used", F.count("*").over(window))


def upserting(table_path: str, key: str = "id"):
    """A ``foreachBatch`` function that keeps the newest result of each key in alternating Parquet folders.

    A batch that was written already is not applied again: a folder counts from the
    moment that its ``_SUCCESS`` is there. A batch that was stopped midway is written
    anew. Folders older than the last two are removed.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        marks = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table_path}/v*/_SUCCESS")) or [] if fs.exists(path) else []
        done = sorted(int(m.getPath().getParent().getName().removeprefix("v")) for m in marks)
        if number in done:
            return
        last = [n for n in done if n < number]
        old = spark.read.parquet(f"{table_path}/v{last[-1]}") if last else batch.limit(0)
        upsert(old, batch, key).write.mode("overwrite").parquet(f"{table_path}/v{number}")
        for n in last[:-1]:  # the one before stays, for readers that began with it
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table_path}/v{n}"), True)

    return apply


#: Why a batch that was sent out may be given up.
GIVEN_UP = ("response_unknown", "cancelled")


def abandoned(results: DataFrame, planned: DataFrame, batch: DataFrame, reason: str) -> DataFrame:
    """Results of a batch that was sent out and of which nothing is known: failed, with ``issues``.

    ``results`` has id; ``planned`` id, original_chars and text_truncated; ``batch`` id.
    Only planned posts without a result get one: what arrived before stays.
    """
    if reason not in GIVEN_UP:
        raise ValueError(f"a batch is given up for one of {GIVEN_UP}")
    open_ = planned.join(batch.select("id").distinct(), "id", "left_semi").join(results.select("id"), "id", "left_anti")
    zero = F.lit(0).cast("long")
    return open_.select(
        "id", F.lit("failed").alias("status"), F.lit("unknown").alias("execution_status"), F.array(F.lit("batch_response_unknown"), F.lit(reason)).alias("issues"),
        "original_chars", zero.alias("checked_chars"), "text_truncated", zero.alias("sources_checked"), zero.alias("matched"), F.lit(None).cast("double").alias("max_similarity"),
    )


def remaining(planned: DataFrame, results: DataFrame) -> DataFrame:
    """The planned posts that a resumed check still has to send: those without any result, given up or not."""
    return planned.join(results.select("id").distinct(), "id", "left_anti")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window with a watermark; an extension that the rules do not need."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "event_type", "events")
