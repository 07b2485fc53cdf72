"""File-change events: what they call for, and bursts of them as one refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tree import SKIPPED, TS_SKIPPED

#: Extensions and files that matter to either segment (fixed values).
CS_EXTENSIONS = ["cs", "csproj", "sln", "slnx"]
TS_EXTENSIONS = ["ts", "tsx", "mts", "cts", "scss"]
PROJECT_FILES = ["tsconfig.json", "package.json"]
DEBOUNCE = "500 milliseconds"


def _name(path: Column) -> Column:
    return F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit(""))


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(_name(path), r"\.([^.]*)$", 1))


def _in_folder(path: Column, folders: list[str]) -> Column:
    full = F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(False)
    for folder in folders:
        out = out | full.contains(f"/{folder}/")
    return out


def classified(events: DataFrame) -> DataFrame:
    """Events (change: created, changed, deleted, renamed; path; old_path) with three flags: `cs` and
    `ts`, whether that segment is refreshed, and `force_full`, whether its files are all read again.

    A file counts by the extension on either side of a rename; an event other than a change without
    any extension may be a folder's; a project file of the TypeScript segment moves its boundaries.
    """
    path, old = F.col("path"), F.col("old_path")
    tracked = lambda wanted: _extension(path).isin(wanted) | F.coalesce(_extension(old).isin(wanted), F.lit(False))
    folder = (F.col("change") != "changed") & (_extension(path) == "") & (F.coalesce(_extension(old), F.lit("")) == "")
    project = F.lower(_name(path)).isin(PROJECT_FILES) | F.coalesce(F.lower(_name(old)).isin(PROJECT_FILES), F.lit(False))
    allowed = ~_in_folder(path, TS_SKIPPED)
    return events.withColumns({
        "cs": ~_in_folder(path, SKIPPED) & (tracked(CS_EXTENSIONS) | folder),
        "ts": allowed & (project | folder | tracked(TS_EXTENSIONS)),
        "force_full": allowed & project,
    })


def scheduled(events: DataFrame) -> DataFrame:
    """One row for each segment that an event calls for: segment, ts, force_full. A change of the
    checked-out branch (kind 'head') refreshes both, the TypeScript one in full; lost events (kind
    'overflow') call for a comparison of both."""
    flags = classified(events)
    kind = F.coalesce(F.col("kind"), F.lit("file"))
    cs = (kind != "file") | F.col("cs")
    ts = (kind != "file") | F.col("ts")
    full = F.when(kind == "head", True).when(kind == "overflow", False).otherwise(F.col("force_full"))
    calls = F.array_compact(F.array(F.when(cs, F.struct(F.lit("cs").alias("segment"), F.lit(False).alias("force_full"))), F.when(ts, F.struct(F.lit("ts").alias("segment"), full.alias("force_full")))))
    return flags.select(F.col("ts_event").alias("ts"), F.explode(calls).alias("call")).select("ts", "call.segment", "call.force_full")


def debounced_batch(calls: DataFrame, gap: str = DEBOUNCE) -> DataFrame:
    """segment, first, last, events, force_full of each burst: calls less than `gap` apart."""
    return (
        calls.groupBy("segment", F.session_window("ts", gap).alias("burst"))
        .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"), F.bool_or("force_full").alias("force_full"))
        .drop("burst")
        .withColumns({"first": F.col("first").cast("timestamp"), "last": F.col("last").cast("timestamp")})
    )


def debounced(calls: DataFrame, gap: str = DEBOUNCE, late: str = "2 seconds") -> DataFrame:
    """The same of a stream; a burst is emitted once the watermark has passed its end."""
    return debounced_batch(calls.withWatermark("ts", late), gap)


def refresh_on(calls: DataFrame, refresh, checkpoint: str, gap: str = DEBOUNCE, trigger: str = "1 second"):
    """Starts a query that calls `refresh(segment, force_full)` for every burst, in order of time."""

    def act(batch: DataFrame, _: int) -> None:
        # a trigger holds at most a burst for each segment and gap
        for row in batch.groupBy("segment").agg(F.bool_or("force_full").alias("force_full"), F.min("first").alias("first")).orderBy("first").collect():
            refresh(row["segment"], row["force_full"])

    return debounced(calls, gap).writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=trigger).start()


def watch(store, scan, checkpoint: str, interval: str = "10 seconds"):
    """Starts a query that compares the tree with the published version every `interval` and
    publishes what has changed. `scan()` gives the tree's files. File streams only see new files;
    comparing times also sees those that were rewritten or removed."""

    def act(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            store.refresh(scan())

    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
