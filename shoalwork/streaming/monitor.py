"""Structured Streaming forms: running monthly areas, keyed latest state, session gaps and lookback state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import upsert
from ..plans.storage import delete

DAY_MS = 86_400_000


def monthly_totals(stream: DataFrame, keys: list[str], when: str, value: str) -> DataFrame:
    """Sums and counts by key and calendar month, for update or complete mode (a month is no fixed window)."""
    return stream.filter(F.col(when).isNotNull()).groupBy(*keys, F.trunc(when, "MM").alias("month")).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def upsert_sink(spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
    """A foreachBatch function that keeps one row per key in Parquet under `path`, in `buckets` parts by a hash of the keys.

    A batch reads and writes the buckets that it touches alone. Each bucket keeps its newest two versions: a batch that is replayed starts from the
    version before its own and writes its own again, so retries change nothing. Of a batch's rows with one key the greatest (as a struct of the
    other columns) counts. Readers take `latest`.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        one = batch.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*") if rest else batch.distinct()
        one = one.select(*batch.columns).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = {r[0] for r in one.select("_bucket").distinct().collect()}  # at most `buckets`
        held = _versions(spark, path)
        old = _read(spark, path, {b: max((v for v in held.get(b, []) if v < epoch), default=None) for b in touched})
        new = one if old is None else upsert(old, one, keys)
        new.withColumn("_version", F.lit(epoch)).repartition("_bucket").write.partitionBy("_bucket", "_version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        one.unpersist()
        for b in touched:
            for v in sorted(v for v in held.get(b, []) if v < epoch)[:-1]:
                delete(spark, f"{path}/_bucket={b}/_version={v}")

    return write


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions of each bucket of an upsert table, by its folders."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs, out = top.getFileSystem(conf), {}
    for b in fs.listStatus(top) if fs.exists(top) else ():
        if b.getPath().getName().startswith("_bucket="):
            names = [v.getPath().getName() for v in fs.listStatus(b.getPath())]
            out[int(b.getPath().getName().split("=")[1])] = [int(n.split("=")[1]) for n in names if n.startswith("_version=")]
    return out


def _read(spark: SparkSession, path: str, versions: dict[int, int | None]) -> DataFrame | None:
    at = [f"{path}/_bucket={b}/_version={v}" for b, v in versions.items() if v is not None]
    return spark.read.option("basePath", path).parquet(*at).drop("_version") if at else None


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of an upsert table as the last batch left them; None if there is none."""
    table = _read(spark, path, {b: max(v, default=None) for b, v in _versions(spark, path).items()})
    return table if table is None else table.drop("_bucket")


def sessions(stream: DataFrame, key: str, when: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events without a gap, closed by the watermark."""
    return stream.withWatermark(when, late).groupBy(F.session_window(when, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def daily_windows(stream: DataFrame, when: str, keys: list[str], value: str, late: str = "1 day") -> DataFrame:
    """Tumbling days with a watermark, for append mode."""
    out = stream.withWatermark(when, late).groupBy(F.window(when, "1 day"), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("day"), *keys, "total", "n")


def deviations(values: np.ndarray, low: np.ndarray, high: np.ndarray, at_once: int = 1_000_000) -> np.ndarray:
    """Sample deviation of each stretch values[low:high] in two passes, NaN under two values; windows are laid out side by side, about at_once values at a time."""
    out, count = np.full(len(low), np.nan), high - low
    rows = np.flatnonzero(count > 1)
    parts = (np.cumsum(count[rows]) - 1) // at_once
    for at in np.split(rows, np.flatnonzero(np.diff(parts)) + 1) if len(rows) else ():
        k = count[at]
        first = np.cumsum(k) - k
        x = values[np.arange(k.sum()) + np.repeat(low[at] - first, k)]
        d = x - np.repeat(np.add.reduceat(x, first) / k, k)
        out[at] = np.sqrt(np.add.reduceat(d * d, first) / (k - 1))
    return out


def lookback_state(stream: DataFrame, key: str, day: str, value: str, days: int = 90, least: int = 3, when: str | None = None, late: str = "1 day") -> DataFrame:
    """For each arriving observation the count, mean and deviation of its key's last `days` days.

    With when (a time column) a key's state goes once the watermark, `late` behind the newest time, has passed all that it could still be asked for; without, it stays.
    State per key: the days and values of two windows up to the newest day, so a row that is late by up to a window still finds its own window whole
    (later rows count what is left of it), and the state stays bounded.
    """

    def step(k, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        old_days, old_values = state.get if state.exists else ([], [])
        got = [(b[day].to_numpy(np.int64), b[value].to_numpy(float)) for b in batches]
        own, new = (np.concatenate(c) for c in zip(*got))
        at, values = np.concatenate((np.array(old_days, np.int64), own)), np.concatenate((np.array(old_values, float), new))
        order = np.argsort(at, kind="stable")
        at, values = at[order], values[order]
        ok = ~np.isnan(values)
        n, s = np.concatenate(([0], np.cumsum(ok))), np.concatenate(([0.0], np.cumsum(np.where(ok, values, 0.0))))
        low, high = np.searchsorted(at, own - days, "right"), np.searchsorted(at, own, "right")
        count = n[high] - n[low]
        mean = (s[high] - s[low]) / np.maximum(count, 1)
        std = deviations(values[ok], n[low], n[high])
        enough = count >= least
        keep = at > at[-1] - 2 * days
        state.update((at[keep].tolist(), values[keep].tolist()))
        if when:
            state.setTimeoutTimestamp(max(int(at[-1] + 2 * days + 1) * DAY_MS, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], day: own, "n_obs": count, "mean": np.where(enough, mean, np.nan), "std": np.where(enough, std, np.nan)})

    kind = stream.schema[key].dataType.simpleString()
    if when:
        stream = stream.withWatermark(when, late)
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {day} long, n_obs long, mean double, std double", "days array<long>, values array<double>", "append", "EventTimeTimeout" if when else "NoTimeout")


def keep_better(stream: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """The best row of each key seen so far (late re-deliveries replace earlier ones), for update mode."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_b")).select(*keys, "_b.*")


def run_to_end(query_frame: DataFrame, mode: str, spark: SparkSession, checkpoint: str, sink) -> list:
    """Processes all that is there, in micro-batches, and stops. Returns the progress of the last batches."""
    q = query_frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress
