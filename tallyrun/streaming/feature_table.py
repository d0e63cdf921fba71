"""One feature row per entity from a stream of events (problem 2).

Method: Structured Streaming keeps, as checkpointed state, the records already seen and per (entity, type) the counter
and the latest timestamp.  After every micro-batch the changed counters are upserted: the entities they belong to get a
new, full feature row in the feature table.

How it scales: deliveries of one record meet by a 128-bit digest of its id, which spreads a hot entity over all tasks;
counting has a map-side part, so that the hot entity's rows reach the state as one row per task and type.  All of it runs
in the JVM.  State grows with the distinct records; where late deliveries have a known bound, ``late_by`` keeps only that
long a window of them (by the source's ``arrived``, else its ``at``).  The feature table lies in buckets of entities; a
micro-batch rewrites only those it touches, as a new version of the bucket, so that a replayed batch writes the same
version again.  The bucket is the hash that also partitions the shuffle, so a task writes its own buckets.

Defined results: an empty stream gives an empty feature table; NULL measures count as nothing in totals; a NULL time
counts but is no latest time; rows without entity are left out; rows without record id count once per distinct content.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrun.session import is_directory, list_names, remove_path, scratch_path
from tallyrun.sources.tables import table_path

#: Input of one micro-batch where the caller sets no bound of their own.
BATCH_BYTES = str(64 << 30)
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


@dataclass(frozen=True)
class EventSource:
    """How the rows of one table become events; ``measures`` are summed per entity under their names."""

    table: str
    columns: Sequence[str]
    entity: Column
    record_id: Column
    kind: Column
    at: Column
    measures: Mapping[str, Column]
    arrived: Column | None = None


def stream_table(spark: SparkSession, folder: str, name: str, **options: str) -> DataFrame:
    """A table's files as a stream, whether it is one file or a directory of files."""
    path = table_path(folder, name)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    if is_directory(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def as_events(rows: DataFrame, source: EventSource, measures: Sequence[str]) -> DataFrame:
    """Columns ``rid, entity, kind, at``, one per measure (0 where the source has none) and ``arrived``.

    ``arrived`` is what lateness is measured by; a record without any time arrives when it is read.
    """
    whole = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in source.columns])
    rid = F.unhex(F.md5(F.concat(F.lit(source.table), F.coalesce(F.concat(F.lit("#"), source.record_id), F.concat(F.lit("?"), whole)))))
    sums = [F.coalesce(source.measures[m].cast("long"), F.lit(0)).alias(m) if m in source.measures else F.lit(0).cast("long").alias(m) for m in measures]
    times = [c.cast("timestamp") for c in (source.arrived, source.at) if c is not None]
    arrived = F.coalesce(*times, F.current_timestamp())
    out = rows.select(rid.alias("rid"), source.entity.alias("entity"), source.kind.alias("kind"), source.at.cast("date").alias("at"), *sums, arrived.alias("arrived"))
    return out.filter(F.col("entity").isNotNull())


def counters(events: DataFrame, measures: Sequence[str], late_by: str | None = None) -> DataFrame:
    """Per (entity, kind): ``n``, latest ``at``, and the sums; each record counted once. Works on streams and tables.

    With ``late_by`` (streams only) a record is remembered that long after the latest arrival seen.
    """
    once = events.withWatermark("arrived", late_by).dropDuplicatesWithinWatermark(["rid"]) if late_by else events.drop("arrived").dropDuplicates(["rid"])
    return once.groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("latest"), *[F.sum(m).alias(m) for m in measures])


def feature_rows(changed: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row per entity with a map from kind to its counter; a kind occurs once per entity, so rows stay small."""
    entry = F.struct(F.col("kind"), F.struct("n", "latest", *measures))
    return changed.groupBy("entity").agg(F.map_from_entries(F.collect_list(entry)).alias("kinds"))


def upsert(previous: DataFrame | None, changed: DataFrame, measures: Sequence[str]) -> DataFrame:
    """The feature table after a batch: changed kinds replace their counters, other kinds and entities stay."""
    rows = feature_rows(changed, measures)
    if previous is None:
        return rows
    old = previous.select("entity", F.col("kinds").alias("old"))
    both = F.map_zip_with("old", "kinds", lambda _, a, b: F.coalesce(b, a))
    merged = F.when(F.col("old").isNull(), F.col("kinds")).when(F.col("kinds").isNull(), F.col("old")).otherwise(both)
    return old.join(rows, "entity", "full_outer").select("entity", merged.alias("kinds"))


@contextmanager
def _settings(spark: SparkSession, values: Mapping[str, str]):  # noqa: ANN202
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class BucketedTable:
    """The feature table: ``table/n<buckets>/v<batch>/bucket=<number>``; of each bucket the highest version holds."""

    def __init__(self, spark: SparkSession, root: str, measures: Sequence[str]) -> None:
        self.spark, self.measures = spark, measures
        self.schema = "entity string, kinds map<string, struct<n: bigint, latest: date" + "".join(f", {m}: bigint" for m in measures) + ">>"
        made = [f for f in list_names(spark, f"{root}/table") if f.startswith("n") and "-" not in f]
        self.buckets = int(made[0][1:]) if made else int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = f"{root}/table/n{self.buckets}"

    def versions(self) -> dict[int, list[int]]:
        """Versions of each bucket, latest first; a batch that did not end (no success mark) has none."""
        out: dict[int, list[int]] = {}
        for v in sorted((int(f[1:]) for f in list_names(self.spark, self.path)), reverse=True):
            names = list_names(self.spark, f"{self.path}/v{v}")
            if "_SUCCESS" in names:
                for f in names:
                    if f.startswith("bucket="):
                        out.setdefault(int(f[7:]), []).append(v)
        return out

    def read(self, buckets: set[int] | None = None, before: int | None = None) -> DataFrame:
        """Current rows: of all buckets or some, as they were before a batch."""
        found = {b: [v for v in vs if before is None or v < before] for b, vs in self.versions().items() if buckets is None or b in buckets}
        paths = [f"{self.path}/v{vs[0]}/bucket={b}" for b, vs in sorted(found.items()) if vs]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, changed: DataFrame, batch: int) -> None:
        """New versions of the buckets that the changed counters touch; versions before the last two are removed."""
        stored = f"{self.path}-changed"  # the stream's state is advanced once only
        changed.write.mode("overwrite").parquet(stored)
        changed = self.spark.read.schema(changed.schema).parquet(stored)
        bucket = F.pmod(F.hash("entity"), F.lit(self.buckets)).alias("bucket")
        touched = {r["bucket"] for r in changed.select(bucket).distinct().collect()}
        had = self.versions()
        previous = self.read(touched, batch) if any(v < batch for b in touched for v in had.get(b, ())) else None
        rows = upsert(previous, changed, self.measures)
        rows.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{batch}")
        remove_path(self.spark, stored)
        for b in touched:
            for v in [v for v in had.get(b, ()) if v < batch][1:]:
                remove_path(self.spark, f"{self.path}/v{v}/bucket={b}")


def build_feature_table(spark: SparkSession, folder: str, sources: Sequence[EventSource], measures: Sequence[str], state: str | None = None, late_by: str | None = None, **options: str) -> DataFrame:
    """Run the stream over all that has arrived and return the feature table: ``entity, kinds``.

    ``state`` is the folder of checkpoint and feature table; with the same folder a later call takes in only what is
    new.  ``options`` go to the stream's reader (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
    """
    root = state or scratch_path(spark, "features")
    if not {"maxFilesPerTrigger", "maxBytesPerTrigger"} & set(options):
        options["maxBytesPerTrigger"] = BATCH_BYTES
    events = None
    for s in sources:
        one = as_events(stream_table(spark, folder, s.table, **options), s, measures)
        events = one if events is None else events.unionByName(one)

    table = BucketedTable(spark, root, measures)

    def after_batch(changed: DataFrame, batch: int) -> None:
        table.upsert(changed, batch)

    with _settings(spark, _STATE):
        writer = counters(events, measures, late_by).writeStream.outputMode("update").foreachBatch(after_batch)
        query = writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return table.read()
