"""Structured Streaming forms of the incremental passes: sessions by silence, repeats within a watermark, new files only."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from gistmill.sources.tables import shared_dir


def _run(stream: DataFrame, label: str, spark: SparkSession) -> DataFrame:
    """Runs a stream over all that is there, into the shared folder, and reads the result."""
    folder = f"{shared_dir(spark).rstrip('/')}/gistmill-{label}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _events(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream with ``at``, straight from their files, and behind them a heartbeat that moves the watermark past every window."""
    still = spark.read.parquet(path)
    folder = f"{shared_dir(spark).rstrip('/')}/gistmill-beat-{uuid.uuid4().hex}"
    beat = still.agg(F.max("ts").alias("last")).where("last is not null").select(*[(F.lit(-1).cast("long") if c == "user_id" else F.lit("heartbeat") if c == "event_type" else F.expr("last + interval 400 days") if c == "ts" else F.lit(None).cast(still.schema[c].dataType)).alias(c) for c in still.columns])
    beat.write.parquet(folder)
    folder_of, _, name = path.rstrip("/").rpartition("/")
    one_file = any(f.endswith("/" + name) for f in still.inputFiles()[:1])  # streams read folders
    files = lambda: spark.readStream.schema(still.schema)
    events = files().option("pathGlobFilter", name).parquet(folder_of) if one_file else files().parquet(path)
    rows = events.unionByName(files().parquet(folder))
    return rows.select("user_id", "event_type", F.expr("cast(ts as timestamp)").alias("at"))


def session_stream(spark: SparkSession, path: str, gap: str = "6 hours", delay: str = "365 days") -> DataFrame:
    """``user_id, started, n_events`` of each run of events without a silence of ``gap``; ``delay``: how far behind an event may come.

    The table's files aren't ordered by time, so its replay allows a year; a live source needs as much as its clocks do.
    """
    found = _events(spark, path).withWatermark("at", delay).groupBy("user_id", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n_events"))
    closed = _run(found.select("user_id", F.col("session_window.start").alias("started"), "n_events"), "sessions", spark)
    return closed.where("user_id != -1").select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n_events")


def deduplicated_stream(spark: SparkSession, path: str, delay: str = "365 days") -> DataFrame:
    """The events, each user, type and time once."""
    once = _events(spark, path).withWatermark("at", delay).dropDuplicatesWithinWatermark(["user_id", "event_type", "at"])
    return _run(once.select("user_id", "event_type", "at"), "once", spark).where("user_id != -1")


def near_repeats_stream(rows: DataFrame, folder: str, seconds: int = 120) -> DataFrame:
    """``rows`` (a stream of ``key, idx, at``) without those whose key came at most ``seconds`` before: a first form of the fold of near copies, for live sources.

    ``folder`` is shared by all executors; what is kept is appended there.
    """
    spark = rows.sparkSession
    once = rows.withWatermark("at", f"{seconds} seconds").dropDuplicatesWithinWatermark(["key"])
    query = once.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/kept").option("checkpointLocation", f"{folder}/kept-progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/kept")


def new_mail(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Reads the mail files below ``source`` that no earlier call with this ``folder`` has read, and returns all records read so far.

    The stream's progress in ``folder`` (shared by all executors) holds which files are known; a changed file is a new one.
    """
    from gistmill.sources.mailfiles import SCHEMA, is_mail_file, read_mail

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(source)
    records = read_mail(files.where(is_mail_file(F.col("path"))))
    query = records.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/records").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(SCHEMA).parquet(f"{folder}/records")


class Progress(StreamingQueryListener):
    """Progress of the session's streams, a line for each batch, to ``tell``; a true answer stops the stream."""

    def __init__(self, spark: SparkSession, tell: Callable[[str], bool | None]):
        self.spark, self.tell = spark, tell

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.tell(f"{event.name or event.id}: started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if self.tell(f"{p.name or p.id}: batch {p.batchId}, {p.numInputRows} rows") and (query := self.spark.streams.get(str(p.id))):
            query.stop()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell(f"{event.id}: ended")
