"""Event-time operators on streams, and the same on tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GRACE_S = 15
#: Upper bounds of the latency buckets, a quarter of an octave apart; the last bucket has none.
BOUNDS = tuple(2 ** (k / 4) for k in range(-40, 61))
#: Where stateful stream processors keep what they know.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def bucket(value: Column) -> Column:
    """The place of a value among the buckets: the number of bounds below it; null for null."""
    low, step = F.lit(-40), F.ceil(F.log2(value) * 4)
    place = F.when(value <= BOUNDS[0], 0).otherwise(F.least(step - low, F.lit(len(BOUNDS)))).cast("int")
    # a logarithm may round to the wrong side of a bound
    bound = lambda at: F.get(F.array(*map(F.lit, BOUNDS)), at)
    sure = F.when((place > 0) & (value <= bound(place - 1)), place - 1).when((place < len(BOUNDS)) & (value > bound(place)), place + 1).otherwise(place)
    return F.when(value.isNotNull(), sure)


def bucket_percentile(buckets: Column, share: float) -> Column:
    """Upper bound of the bucket in which a percentile lies, from an array of structs (at, n); null without values, infinity beyond the last bound."""
    order = F.array_sort(buckets)
    total = F.aggregate(order, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at"))
    found = F.aggregate(order, start, lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["at"], F.when(a["seen"] + x["n"] >= F.ceil(total * share), x["at"])).alias("at")))["at"]
    return F.coalesce(F.get(F.array(*map(F.lit, BOUNDS)), found), F.when(found >= len(BOUNDS), F.lit(float("inf"))))


def latency_buckets(requests: DataFrame, watermark: str | None = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(hour, path, bucket, n, total, most): requests (ts, path, duration) by hour, path and latency bucket. Buckets of any parts add up. On a stream, rows later than the watermark are dropped.

    Requests without a duration are counted under bucket -1.
    """
    rows = requests.withWatermark("ts", watermark) if watermark and requests.isStreaming else requests
    place = F.coalesce(bucket(F.col("duration")), F.lit(-1))
    per = rows.groupBy(F.window("ts", width), "path", place.alias("bucket")).agg(F.count("*").alias("n"), F.sum("duration").alias("total"), F.max("duration").alias("most"))
    return per.select(F.date_format(F.col("window.start"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "path", "bucket", "n", "total", "most")


def latency_summary(buckets: DataFrame, *group: str) -> DataFrame:
    """Requests, mean, greatest, p50 and p95 (upper bounds of their buckets) by group, from buckets of a stream or a table."""
    kind = "array<struct<at:int,n:bigint>>"
    each = buckets.groupBy(*group, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))
    timed = F.col("bucket") >= 0
    per = each.groupBy(*group).agg(
        F.sum("n").alias("n"),
        F.round(F.sum("total") / F.nullif(F.sum(F.when(timed, F.col("n"))), F.lit(0)), 6).alias("mean"),
        F.max("most").alias("most"),
        F.collect_list(F.when(timed, F.struct(F.col("bucket").alias("at"), "n"))).cast(kind).alias("_buckets"),
    )
    share = lambda s: F.round(bucket_percentile(F.col("_buckets"), s), 6)
    return per.select(*group, "n", "mean", "most", share(0.5).alias("p50"), share(0.95).alias("p95"))


def latency_histogram(requests: DataFrame, watermark: str | None = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Requests (ts, path, duration) a path and hour: count, mean and greatest duration. On a stream, rows later than the watermark are dropped."""
    rows = requests.withWatermark("ts", watermark) if watermark and requests.isStreaming else requests
    per = rows.groupBy(F.window("ts", width), "path").agg(F.count("*").alias("n"), F.round(F.avg("duration"), 6).alias("mean"), F.max("duration").alias("most"))
    return per.select(F.date_format(F.col("window.start"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "path", "n", "mean", "most")


def expired_batch(beats: DataFrame, ttl_s: int, grace_s: int = GRACE_S, until: str | None = None) -> DataFrame:
    """(key, last_beat, expired_at): each silence of a key longer than lease and grace, also after its last beat if ``until`` lies past it."""
    nxt = F.lead("ts").over(Window.partitionBy("key").orderBy("ts"))
    end = F.coalesce("next", F.lit(until).cast("timestamp") if until else F.lit(None).cast("timestamp"))
    due = F.col("ts") + F.make_interval(secs=F.lit(ttl_s + grace_s))
    return beats.withColumn("next", nxt).withColumn("due", due).where(end > F.col("due")).select("key", F.col("ts").alias("last_beat"), F.col("due").alias("expired_at"))


class Lease(StatefulProcessor):
    """The last beat of a key, and a timer in event time for when its lease and grace are over.

    A beat at or before the known last one changes nothing. One behind the end of the lease reports the silence at once, as its timer may not have fired yet.
    The timer that fires reports the silence and forgets the key; a late beat of before it then opens no new lease, because it lies before the watermark.
    """

    def __init__(self, span_ms: int) -> None:
        self.span = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def _silence(self, key: Any, last: int) -> pd.DataFrame:
        stamp = lambda ms: [pd.Timestamp(ms, unit="ms")]
        return pd.DataFrame({"key": [key[0]], "last_beat": stamp(last), "expired_at": stamp(last + self.span)})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.last.get()[0] if self.last.exists() else None
        last = before
        for ms in sorted(int(x) for part in rows for x in part["ms"]):
            if last is not None and ms > last + self.span:
                yield self._silence(key, last)
            last = ms if last is None else max(last, ms)
        if last is not None and last != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((last,))
            # the lease is over when the watermark is past its end
            self.handle.registerTimer(max(last + self.span, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists():
            (last,) = self.last.get()
            self.last.clear()
            yield self._silence(key, last)

    def close(self) -> None:
        pass


def expired_stream(beats: DataFrame, ttl_s: int, grace_s: int = GRACE_S, watermark: str = "0 seconds") -> DataFrame:
    """Keys whose last beat is older than lease and grace in event time; a late beat does not bring an expired key back.

    ``beats``: (key string, ts timestamp). State is one time stamp a key; its timer fires with the watermark. The session is set to keep state as ``STATE_STORE`` says.
    """
    beats.sparkSession.conf.set(*STATE_STORE)
    rows = beats.withWatermark("ts", watermark).withColumn("ms", F.unix_millis("ts"))
    lease = Lease((ttl_s + grace_s) * 1000)
    return rows.groupBy("key").transformWithStateInPandas(lease, "key string, last_beat timestamp, expired_at timestamp", "Append", "EventTime")
