"""Structured Streaming forms of the daily roll-up, the soiling state, dry spells, and the feedback ingest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelspark.config import EquivalentDay, Kimber
from panelspark.functions.names import valid_partner
from panelspark.sources.sinks import feedback_record

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def daily_means_stream(hourly: DataFrame, values: Sequence[str], delay: str = "1 day", station: str = "station_id",
                       ts: str = "ts") -> DataFrame:
    """Tumbling daily means; a day leaves once the watermark has passed its end, later rows are dropped."""
    day = F.window(ts, "1 day")
    return (
        hourly.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(station, day)
        .agg(*[F.avg(v).alias(v) for v in values]).select(station, F.to_date("window.start").alias("dt"), *values)
    )


def dry_spells_stream(daily: DataFrame, threshold_mm: float = 1.0, delay: str = "1 day",
                      station: str = "station_id") -> DataFrame:
    """Dry days joined into spells; a missing or wet day in between ends the spell.

    The gap of 36 hours joins neighbouring days and nothing further apart.
    """
    dry = daily.where(F.coalesce("precipitation_sum", F.lit(0.0)) < threshold_mm).withColumn("ts", F.col("dt").cast("timestamp"))
    return (
        dry.withWatermark("ts", delay).groupBy(station, F.session_window("ts", "36 hours"))
        .agg(F.count(F.lit(1)).alias("n_days"), F.max("dt").alias("last_day"))
        .select(station, F.to_date("session_window.start").alias("first_day"), "last_day", "n_days")
    )


#: A state holds the locations whose ids differ in their last bits only, 64 at most; neighbouring ids share one.
GROUP_BITS = 6
#: Days before all days; also a heavy rain that was never seen.
NEVER = -(2**40)
#: The group of rows without a location; no id is in it.
NOWHERE = -(2**63)
DAYS = np.dtype([("station", "i8"), ("day", "i8"), ("rain", "f8"), ("fine", "f8"), ("coarse", "f8")])
SITES = np.dtype([("station", "i8"), ("day", "i8"), ("eqd", "f8"), ("ratio", "f8"), ("last_rain", "i8"), ("dropped", "i8")])


class RunningSoiling(StatefulProcessor):
    """Per location: days wait until the watermark passes them, then advance the state in date order.

    A state holds a few neighbouring locations, their days as packed rows, since a call and a value of a state cost far
    more than a day. One timer per group, at the end of its earliest waiting day; when it fires, every day the watermark
    has passed is applied, so the work per batch does not grow with the number of waiting days times timers.
    """

    def __init__(self, eqd: EquivalentDay, kimber: Kimber):
        self.eqd, self.kimber = eqd, kimber

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "days BINARY")
        self.state = handle.getValueState("state", "sites BINARY, timer BIGINT")

    def _current(self) -> tuple[np.ndarray, int | None]:
        """Locations in the order of their ids, and the timer."""
        if not self.state.exists():
            return np.empty(0, SITES), None
        sites, timer = self.state.get()
        return np.frombuffer(bytes(sites), SITES).copy(), timer

    def _schedule(self, timer: int | None, earliest: int | None) -> int | None:
        """Move the group's timer to the end of the earliest waiting day."""
        wanted = None if earliest is None else (earliest + 1) * DAY_MS
        if wanted is not None and (timer is None or wanted < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
            return wanted
        return timer

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sites, timer = self._current()
        earliest = None
        for pdf in rows:
            days = np.empty(len(pdf), DAYS)
            for name in DAYS.names:
                days[name] = pdf[name].to_numpy()
            new = np.setdiff1d(days["station"], sites["station"])
            if len(new):
                more = np.zeros(len(new), SITES)
                more["station"], more["day"], more["ratio"], more["last_rain"] = new, NEVER, 1.0, NEVER
                sites = np.concatenate([sites, more])
                sites = sites[np.argsort(sites["station"])]
            at = np.searchsorted(sites["station"], days["station"])
            late = days["day"] <= sites["day"][at]
            sites["dropped"] += np.bincount(at[late], minlength=len(sites))
            fresh = days[~late]
            if len(fresh):
                self.pending.appendValue((fresh.tobytes(),))
                first = int(fresh["day"].min())
                earliest = first if earliest is None else min(earliest, first)
        self.state.update((sites.tobytes(), self._schedule(timer, earliest)))
        yield pd.DataFrame()

    def _factors(self, days: np.ndarray) -> np.ndarray:
        p, rain = self.eqd, days["rain"]
        dusty = 1.0 + p.pm10_dust_scale * np.maximum(0.0, days["coarse"] - p.pm10_dust_threshold)
        damp = 1.0 - (rain - p.rain_min_mm) / (p.heavy_rain_mm - p.rain_min_mm)
        return np.where(rain >= p.heavy_rain_mm, 0.0, np.where(rain >= p.rain_min_mm, damp, dusty))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() // DAY_MS
        waiting = np.concatenate([np.empty(0, DAYS), *[np.frombuffer(bytes(r[0]), DAYS) for r in self.pending.get()]])
        passed = waiting["day"] < limit
        ready, kept = waiting[passed], waiting[~passed]
        ready = ready[np.lexsort([ready[name] for name in reversed(DAYS.names)])]
        sites, _ = self._current()
        heavy = ready["rain"] >= self.eqd.heavy_rain_mm
        washed = ready["rain"] >= self.kimber.rain_clean_mm
        factors, losses = self._factors(ready), self.kimber.deposition_per_pm25 * ready["fine"]
        eqds, ratios, last = np.empty(len(ready)), np.empty(len(ready)), np.where(heavy, ready["day"], NEVER)
        names, starts = np.unique(ready["station"], return_index=True)
        for name, start, end in zip(names, starts, [*starts[1:], len(ready)]):
            site, own = sites[np.searchsorted(sites["station"], name)], slice(start, end)
            eqd, ratio, path, clean = float(site["eqd"]), float(site["ratio"]), [], []
            for factor, wash, loss in zip(factors[own].tolist(), washed[own].tolist(), losses[own].tolist()):
                eqd = factor * (eqd + 1.0)
                ratio = 1.0 if wash else max(0.0, ratio - loss)
                path.append(eqd)
                clean.append(ratio)
            eqds[own], ratios[own] = path, clean
            last[own] = np.maximum.accumulate(np.maximum(last[own], site["last_rain"]))
            site["day"], site["eqd"], site["ratio"], site["last_rain"] = ready["day"][end - 1], eqd, ratio, last[end - 1]
        self.pending.clear()
        if len(kept):
            self.pending.appendValue((kept.tobytes(),))
        self.state.update((sites.tobytes(), self._schedule(None, int(kept["day"].min()) if len(kept) else None)))
        for i in range(0, len(ready), 50_000):
            own = slice(i, i + 50_000)
            yield pd.DataFrame({"known": key[0] != NOWHERE, "station": ready["station"][own], "day": ready["day"][own], "eqd": eqds[own],
                                "soiling_ratio": ratios[own], "last_rain": last[own]})

    def close(self) -> None:
        pass


def soiling_state_stream(daily: DataFrame, delay: str = "1 day", eqd: EquivalentDay = EquivalentDay(),
                         kimber: Kimber = Kimber(), station: str = "station_id") -> DataFrame:
    """Running equivalent days and clean ratio per location. Needs the RocksDB state store."""
    daily.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    reading = lambda c, default: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(default)))
    site = F.col(station).cast("bigint")
    rows = daily.withColumn("ts", F.col("dt").cast("timestamp")).withWatermark("ts", delay).select(
        "ts", F.coalesce(F.shiftright(site, GROUP_BITS), F.lit(NOWHERE)).alias("group"), F.coalesce(site, F.lit(0)).alias("station"),
        F.unix_date("dt").cast("bigint").alias("day"), reading("precipitation_sum", 0.0).alias("rain"),
        reading("pm2_5", kimber.empty_series_pm25).alias("fine"), reading("pm10", 0.0).alias("coarse"))
    out = rows.groupBy("group").transformWithStateInPandas(
        RunningSoiling(eqd, kimber), "known BOOLEAN, station BIGINT, day BIGINT, eqd DOUBLE, soiling_ratio DOUBLE, last_rain BIGINT",
        "append", "eventTime")
    as_date = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    return out.select(
        F.when(F.col("known"), F.col("station")).alias(station), as_date("day").alias("dt"), "eqd", "soiling_ratio",
        F.when(F.col("last_rain") > NEVER, as_date("last_rain")).alias("last_rain_date"))


def feedback_stream(events: DataFrame, path: str, checkpoint: str, dedupe: bool = False,
                    delay: str = "1 day") -> StreamingQuery:
    """T4: validate, add the recovery, append. Repeats are kept unless asked otherwise.

    Each batch has a folder of its own, so a batch that is run again after a restart replaces what it wrote.
    """
    rows = events
    if dedupe:
        rows = rows.withColumn("_ts", F.col("cleaned_at").cast("timestamp")).withWatermark("_ts", delay).dropDuplicatesWithinWatermark(
            ["partner_id", "array_id", "cleaned_at"]).drop("_ts")
    rows = rows.where(valid_partner(F.col("partner_id")))

    def append(batch: DataFrame, epoch: int) -> None:
        feedback_record(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={epoch}")

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain the available input into a parquet folder and read it back."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
