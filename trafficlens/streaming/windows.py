"""Client windows and rules as a Structured Streaming job."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from trafficlens.functions.rules import Thresholds
from trafficlens.operators.windows import apply_rules


def stream_window_counts(
    enriched: DataFrame,
    watermark: str = "10 minutes",
    duration: str = "1 minute",
    slide: str | None = None,
    key: str = "ip",
) -> DataFrame:
    """The measures of ``operators.windows.window_counts`` on a stream.

    Streams have no distinct count, so the endpoints get an aggregation of their
    own: state holds one small row per (client, window, endpoint), spread by all
    three, and a second aggregation counts them. No state row ever holds a list,
    however many endpoints a client asks for.
    """
    level = F.col("error_severity")
    per_endpoint = (
        enriched.withWatermark("timestamp", watermark)
        .groupBy(key, F.window("timestamp", duration, slide), "endpoint")
        .agg(
            F.count("*").alias("request_count"),
            F.sum("is_error").alias("error_count"),
            F.sum("bytes").alias("bytes_sum"),
            F.count("bytes").alias("bytes_known"),
            F.sum("is_bot").alias("bot_requests"),
            F.sum("is_off_hours").alias("off_hours_requests"),
            F.count_if(level == "fatal").alias("fatal_count"),
            F.count_if(level == "medium").alias("medium_count"),
            F.count_if(level == "low").alias("low_count"),
        )
    )

    def total(name):
        return F.sum(name).alias(name)

    counts = per_endpoint.groupBy(key, "window").agg(
        total("request_count"),
        total("error_count"),
        total("bytes_sum"),
        total("bytes_known"),
        F.count("*").alias("unique_endpoints"),
        total("bot_requests"),
        total("off_hours_requests"),
        total("fatal_count"),
        total("medium_count"),
        total("low_count"),
    )
    return counts.select(
        key,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "request_count",
        "error_count",
        F.try_divide(F.col("bytes_sum").cast("double"), "bytes_known").alias("avg_bytes"),
        "unique_endpoints",
        "bot_requests",
        "off_hours_requests",
        "fatal_count",
        "medium_count",
        "low_count",
        (F.col("error_count") / F.col("request_count")).alias("error_rate"),
    )


def stream_client_windows(
    enriched: DataFrame,
    limits: Thresholds = Thresholds(),
    watermark: str = "10 minutes",
    duration: str = "1 minute",
    slide: str | None = None,
    key: str = "ip",
) -> DataFrame:
    return apply_rules(stream_window_counts(enriched, watermark, duration, slide, key), limits)


def start(
    windows: DataFrame, path: str, checkpoint: str, once: bool = False, name: str | None = None
) -> StreamingQuery:
    """Append closed windows to parquet at ``path``.

    The job resumes from ``checkpoint``; started again with another one it would write
    all windows anew. ``once`` works off what is there and stops.
    """
    writer = (
        windows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if once else writer).start()


# -- what the window job itself drops ---------------------------------------------

READ = "rows_read"
_LEDGER = "batch long, rows long, state_rows_dropped long"


def observed(enriched: DataFrame) -> DataFrame:
    """The same rows, counted batch by batch as they pass: those that windows can hold."""
    return enriched.observe(READ, F.count("timestamp").alias("rows"))


class Ledger(StreamingQueryListener):
    """Writes for every batch of a job how many rows it read, one small file a batch.

    A batch that is run again writes its file again, so it counts once. ``state_rows_dropped``
    is Spark's own figure, of partial sums and not of rows: more than 0 exactly if some
    row was late.
    """

    def __init__(self, spark: SparkSession, folder: str, checkpoint: str):
        self._spark, self.folder, self._checkpoint = spark, folder.rstrip("/"), checkpoint

    def onQueryStarted(self, event) -> None:  # noqa: N802 (the interface's name)
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        if str(progress.name) == self.job:
            found = progress.observedMetrics.get(READ)
            note = {
                "batch": progress.batchId,
                "rows": (found["rows"] or 0) if found is not None else 0,
                "state_rows_dropped": sum(s.numRowsDroppedByWatermark for s in progress.stateOperators),
            }
            self._write(f"{self.folder}/{progress.batchId:012d}.json", json.dumps(note))

    @property
    def job(self) -> str:
        """The name under which the job runs: that of its checkpoint."""
        return f"windows {self._checkpoint}"

    def _write(self, path: str, text: str) -> None:
        place = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        out = place.getFileSystem(self._spark._jsc.hadoopConfiguration()).create(place, True)
        out.writeBytes(text)
        out.close()


def run_counted(windows: DataFrame, path: str, checkpoint: str, ledger: str, patience: float = 60.0) -> None:
    """Work off what has arrived, as ``start`` with ``once``, and note the rows of every batch.

    ``windows`` has to be made from ``observed`` rows. Returns when the note of the last
    batch is there; raises if it does not come within ``patience`` seconds.
    """
    spark = windows.sparkSession
    listener = Ledger(spark, ledger, checkpoint)
    spark.streams.addListener(listener)
    try:
        query = start(windows, path, checkpoint, once=True, name=listener.job)
        query.awaitTermination()
        last, until = _last_number(spark, f"{checkpoint}/commits"), time.monotonic() + patience
        while _last_number(spark, ledger) < last:
            if time.monotonic() > until:
                raise TimeoutError(f"no note of batch {last} in {ledger}")
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)


def _last_number(spark: SparkSession, folder: str) -> int:
    """The greatest number that names a file of a folder, -1 if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return -1
    names = (f.getPath().getName().removesuffix(".json") for f in files.listStatus(place))
    return max((int(n) for n in names if n.isdigit()), default=-1)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(batch, rows, state_rows_dropped) of every batch so far."""
    return spark.read.schema(_LEDGER).json(ledger)


def open_rows(spark: SparkSession, checkpoint: str) -> int:
    """Rows in windows that the job holds in its state, from its last checkpoint."""
    operators = spark.read.format("state-metadata").load(checkpoint).select("operatorId").distinct()
    total = 0
    for row in operators.collect():
        state = spark.read.format("statestore").option("operatorId", row.operatorId).load(checkpoint)
        # both aggregations keep the number of requests first
        values = state.select(F.inline(F.array("value")))
        first = values.toDF(*(f"c{i}" for i in range(len(values.columns)))).agg(F.sum("c0")).first()[0]
        total += first or 0
    return total


def dropped_rows(spark: SparkSession, windows: str, checkpoint: str, ledger: str) -> DataFrame:
    """(rows_read, emitted, still_open, dropped): what became of every row that the job read.

    Nothing is estimated from times: a row that was read and is neither in a window
    that was emitted nor in one that is still open was dropped as late. Call it between
    runs of the job.
    """
    read = read_ledger(spark, ledger).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias(READ))
    emitted = spark.read.parquet(windows).agg(F.coalesce(F.sum("request_count"), F.lit(0))).first()[0]
    held = open_rows(spark, checkpoint)
    return read.select(
        READ,
        F.lit(emitted).cast("long").alias("emitted"),
        F.lit(held).cast("long").alias("still_open"),
        (F.col(READ) - emitted - held).cast("long").alias("dropped"),
    )


# -- late rows of any stream ------------------------------------------------------

LATE_ROWS = "rows long, late_rows long, latest timestamp"


def note_late_rows(
    enriched: DataFrame,
    path: str,
    checkpoint: str,
    watermark: str = "10 minutes",
    duration: str = "1 minute",
    once: bool = False,
) -> StreamingQuery:
    """Count the rows of each micro-batch, and those behind the watermark, into ``path``.

    Late is a row whose window had ended, less the delay, by the latest time of the
    batches before the last one: what Spark drops as long as batch follows batch. (A
    window job that runs idle in between moves its watermark on and may drop rows of
    the next batch too; ``dropped_rows`` tells what such a job did drop.) Every batch
    writes a folder of its own, so a repeated batch counts once. ``latest`` is the latest
    time up to and with the batch, so a batch reads two earlier notes and no more.
    """
    spark = enriched.sparkSession

    def note(batch: DataFrame, number: int) -> None:
        before = {
            back: spark.read.schema(LATE_ROWS).parquet(f"{path}/batch={number - back}").first()["latest"]
            for back in (1, 2)
            if number >= back
        }
        latest = before.get(2)
        end = F.window("timestamp", duration)["end"]
        late = end <= F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {watermark}")
        counts = batch.filter("timestamp IS NOT NULL").agg(
            F.count("*").alias("rows"),
            F.count_if(F.coalesce(late, F.lit(False))).alias("late_rows"),
            F.greatest(F.max("timestamp"), F.lit(before.get(1)).cast("timestamp")).alias("latest"),
        )
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = enriched.writeStream.foreachBatch(note).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def late_row_notes(spark: SparkSession, path: str) -> DataFrame:
    """(rows, late_rows, latest, batch) that ``note_late_rows`` has written so far."""
    return spark.read.schema(f"{LATE_ROWS}, batch long").parquet(path)
