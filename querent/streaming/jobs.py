"""The incremental jobs as Structured Streaming queries.

Every job takes a streaming DataFrame and starts a query with a checkpoint; the
same code runs once over what is there (``available_now``) or without end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import scores as sc
from ..operators import quality as ql
from ..operators.interview import KEYS
from ..operators.ranking import first_seen, latest
from ..operators.vectors import embed, index_rows
from ..session import path_exists


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(path)


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start(writer, checkpoint: str, available_now: bool, spark: SparkSession | None = None) -> StreamingQuery:
    """Start a query; one with a ``spark`` keeps its state in RocksDB, on disk, whatever its size."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    if spark is None:
        return writer.start()
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKSDB)  # a query copies the settings when it starts
    try:
        return writer.start()
    finally:
        spark.conf.set(_STORE, before)


def unseen(rows: DataFrame, key: str, time: str | None = None, within: str = "30 days") -> DataFrame:
    """Rows of a stream whose ``key`` has not come before, kept as state.

    With an event ``time`` keys are forgotten ``within`` after they came, and
    rows later than that are dropped; without one they are kept for good.
    """
    if time is None:
        return rows.dropDuplicates([key])
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def index_stream(
    chunks: DataFrame, path: str, checkpoint: str, encoder, text: str = "content", available_now: bool = True,
    key: str = "chunk_id", time: str | None = None, within: str = "30 days",
) -> StreamingQuery:
    """Embed and append only chunk ids the stream has not seen.

    What came before is state of the query: the index is not read again, however
    large it is.  Each batch writes a folder of its own, over what an earlier try
    of it left.  Ids are hashes of the content, so it is no matter which of two
    equal ones is kept.
    """

    def add(batch: DataFrame, number: int) -> None:
        index_rows(embed(batch, text, encoder)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = unseen(chunks, key, time, within).writeStream.foreachBatch(add)
    return _start(writer, checkpoint, available_now, chunks.sparkSession)


def evaluation_stream(
    answers: DataFrame, path: str, checkpoint: str, scorer: Callable[[DataFrame], DataFrame], available_now: bool = True, order: str = "id"
) -> StreamingQuery:
    """Score answers not scored yet, one evaluation per (session, question): of the first answer of a batch by ``order``."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = first_seen(batch, KEYS, order)
        if path_exists(spark, path):
            fresh = fresh.join(spark.read.parquet(path).select(*KEYS), KEYS, "left_anti")
        scorer(fresh).write.mode("append").parquet(path)

    return _start(answers.writeStream.foreachBatch(add), checkpoint, available_now)


def unscored(answers: DataFrame, evaluations: DataFrame, bound: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Answers of a stream to which no evaluation came within ``bound``.

    ``answers`` has the keys and ``answered_at``, ``evaluations`` the keys and
    ``evaluated_at``; rows of either may come up to ``late`` behind the newest
    one.  An answer is told once both streams have passed its bound, and both
    sides leave the state then.
    """
    told = evaluations.select(*[F.col(k).alias(f"_{k}") for k in KEYS], "evaluated_at").withWatermark("evaluated_at", late)
    given = answers.withWatermark("answered_at", late)
    same = [given[k] == told[f"_{k}"] for k in KEYS]
    span = (told["evaluated_at"] >= given["answered_at"]) & (told["evaluated_at"] <= given["answered_at"] + F.expr(f"interval {bound}"))
    joined = given.join(told, same[0] & same[1] & span, "left_outer")
    return joined.where("evaluated_at is null").select(*answers.columns)


def backlog_stream(
    answers: DataFrame, evaluations: DataFrame, path: str, checkpoint: str, bound: str = "1 hour", late: str = "1 hour",
    available_now: bool = True,
) -> StreamingQuery:
    """Write the answers left without an evaluation, a folder per batch; ``first_answers`` reads them."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _start(unscored(answers, evaluations, bound, late).writeStream.foreachBatch(add), checkpoint, available_now, answers.sparkSession)


def first_answers(backlog: DataFrame, order: str = "id") -> DataFrame:
    """The earliest answer to each question of a session, ties by ``order``."""
    return first_seen(backlog, KEYS, "answered_at", order)


def session_progress(events: DataFrame, late: str = "30 days", span: str | None = None) -> DataFrame:
    """Per session: first and last event, number asked, last kind of event.

    ``events`` has session_id, ts (timestamp), kind.  The watermark bounds how
    late an event may come.  With a ``span`` progress is kept per session and
    span of time (``day`` for "1 day"), and the state of a span ends when the
    watermark has passed it; ``whole_sessions`` puts the spans together.
    """
    keys = ["session_id"] + ([F.window("ts", span)["start"].alias("day")] if span else [])
    return (
        events.withWatermark("ts", late)
        .groupBy(*keys)
        .agg(
            F.min("ts").alias("start_time"),
            F.max("ts").alias("last_time"),
            F.count_if(F.col("kind") != "error").alias("asked"),
            F.max_by("kind", F.struct("ts", "kind")).alias("last_kind"),
        )
    )


def with_limits(progress: DataFrame, minutes: float, questions: int) -> DataFrame:
    elapsed = sc.elapsed_minutes(
        F.unix_micros("start_time"), F.unix_micros("last_time"), digits=None
    )
    return progress.withColumn("minutes", elapsed).withColumn(
        "should_end", sc.should_end(F.col("minutes"), F.lit(minutes), F.col("asked"), F.lit(questions))
    )


def whole_sessions(progress: DataFrame) -> DataFrame:
    """Progress per session from stored rows (session_id, day, …, batch): the row of
    the highest batch counts for each day, and the days of a session add up."""
    now = latest(progress, ["session_id", "day"], "batch")
    return now.groupBy("session_id").agg(
        F.min("start_time").alias("start_time"), F.max("last_time").alias("last_time"), F.sum("asked").alias("asked"),
        F.max_by("last_kind", F.struct("last_time", "last_kind")).alias("last_kind"),
    )


def progress_stream(
    events: DataFrame, path: str, checkpoint: str, available_now: bool = True, late: str = "30 days", span: str = "1 day"
) -> StreamingQuery:
    """Keep the current progress row of every session and day that changed.

    Each batch writes the changed rows under its number, over what an earlier
    try of the same batch left; ``whole_sessions`` reads them.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = session_progress(events, late, span).writeStream.outputMode("update").foreachBatch(add)
    return _start(writer, checkpoint, available_now)


def quality_stream(chunks: DataFrame, valid_path: str, invalid_path: str, checkpoint: str, available_now: bool = True, **limits) -> StreamingQuery:
    """Validate chunks and part them into two tables, one folder per batch.

    A batch that is run again after a failure overwrites its own folders, so no
    row doubles.
    """

    def split(batch: DataFrame, number: int) -> None:
        checked = ql.validate_chunks(batch, **limits).persist()
        checked.where("is_valid").write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
        checked.where(~F.col("is_valid")).write.mode("overwrite").parquet(f"{invalid_path}/batch={number}")
        checked.unpersist()

    return _start(chunks.writeStream.foreachBatch(split), checkpoint, available_now)


def _intervals(times, silence: int) -> list[tuple[int, int, int]]:
    """(first, last, number) of runs of sorted times without a longer silence."""
    import numpy as np

    cuts = np.flatnonzero(np.diff(times) > silence) + 1
    return [(int(x[0]), int(x[-1]), len(x)) for x in np.split(times, cuts) if len(x)]


class SessionTimeout:
    """Emit a session once it has been silent for a while (event time).

    State per session: first and last event and how many there were.  Events
    behind a silence begin a new session, whether or not the end of the old one
    has been told yet.
    """

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle):
        self.handle = handle
        self.seen = handle.getValueState("seen", "first bigint, last bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        times = np.sort(np.concatenate([pdf["ts"].astype("datetime64[ms]").astype("int64").to_numpy() for pdf in rows]))
        runs = _intervals(times, self.silence_ms)
        if self.seen.exists():
            runs = sorted([*runs, tuple(self.seen.get())])
        joined = [runs[0]]
        for first, last, n in runs[1:]:
            if first - joined[-1][1] <= self.silence_ms:
                a, b, m = joined.pop()
                first, last, n = a, max(b, last), m + n
            joined.append((first, last, n))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(joined[-1][1] + self.silence_ms)
        self.seen.update(joined[-1])
        yield pd.DataFrame(
            [(key[0], *run) for run in joined[:-1]], columns=["session_id", "first_ms", "last_ms", "events"]
        ).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        first, last, n = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({"session_id": [key[0]], "first_ms": [first], "last_ms": [last], "events": [n]})

    def close(self):
        pass


def timeout_stream(events: DataFrame, silence_ms: int, late: str = "1 hour") -> DataFrame:
    """Sessions that ended by silence; needs the RocksDB state store, as ``ended_stream`` sets it."""
    from pyspark.sql.streaming import StatefulProcessor

    processor = type("Timeout", (SessionTimeout, StatefulProcessor), {})(silence_ms)
    return (
        events.withWatermark("ts", late)
        .groupBy("session_id")
        .transformWithStateInPandas(
            statefulProcessor=processor,
            outputStructType="session_id bigint, first_ms bigint, last_ms bigint, events bigint",
            outputMode="append",
            timeMode="EventTime",
        )
    )


def ended_stream(
    events: DataFrame, path: str, checkpoint: str, silence_ms: int, late: str = "1 hour", available_now: bool = True
) -> StreamingQuery:
    """Append the sessions that ended by silence to a Parquet table, each once."""
    writer = timeout_stream(events, silence_ms, late).writeStream.format("parquet").option("path", path).outputMode("append")
    return _start(writer, checkpoint, available_now, events.sparkSession)
