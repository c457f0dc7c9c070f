"""Sources and sinks: reports, the registry and the log, replicas, covers.

Snapshots are written to a new directory and become current when a marker names them. Markers are only added, and the
last one counts, so readers never see half a snapshot or none. The log is append-only and partitioned by day; its ids
are unique over all days, by an index of ids that is committed with each append. All paths go through Hadoop's file
system API or Spark's readers and writers, so any store that Spark reaches will do.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readlog import schemas
from readlog.sources.ledger import AlreadyCommitted, Ledger
from readlog.sources.paths import hadoop_path


def checkpoint(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the folder that the cluster shares."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="readlog-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, with nulls for those that an older snapshot lacks."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def read_reports(spark: SparkSession, path: str, form: str = "json", streaming: bool = False) -> DataFrame:
    """Reports as sent; a missing read_at becomes the time of reading."""
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(schemas.REPORTS).format(form).load(path)
    return rows.withColumn("read_at", F.coalesce("read_at", F.current_timestamp()))


#: Parts of the index of event ids, by hash: an append reads the parts that its own ids fall into.
ID_PARTS = 1024


def _log(spark: SparkSession, folder: str) -> Ledger:
    return Ledger(spark, f"{folder}/events")


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    rows = _log(spark, folder).read("events")
    return spark.createDataFrame([], schemas.EVENTS) if rows is None else conform(rows, schemas.EVENTS)


def _id_part() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(ID_PARTS)).cast("int")


def unknown_ids(rows: DataFrame, folder: str) -> DataFrame:
    """The rows whose id the log doesn't have, whatever their day. Only the index is read, and of it the parts of these
    ids, of which there are at most ID_PARTS."""
    known = _log(rows.sparkSession, folder).read("ids")
    if known is None:
        return rows
    touched = [r.part for r in rows.select(_id_part().alias("part")).distinct().collect()]
    return rows.join(known.filter(F.col("part").isin(touched)).select("id"), "id", "left_anti")


def append_events(events: DataFrame, folder: str) -> None:
    """Append the events whose id isn't in the log yet; of rows with one id the earliest counts. A null id is never appended.

    Events and ids count from one moment; if another writer was faster, the ids are looked up again.
    """
    rows = conform(events, schemas.EVENTS).filter("id IS NOT NULL")
    rows = rows.groupBy("id").agg(F.min_by(F.struct("*"), F.struct("read_at", "series_id", "chapter_label")).alias("e")).select("e.*")
    rows = checkpoint(rows.withColumn("read_date", F.to_date("read_at")))
    log = _log(events.sparkSession, folder)
    parts = {"events": "read_date", "ids": "part"}
    while True:
        batch = log.next_batch()
        new = unknown_ids(rows, folder)
        try:
            log.commit(batch, {"events": new.hint("rebalance", F.col("read_date")), "ids": new.select("id", _id_part().alias("part")).hint("rebalance", F.col("part"))}, parts)
            break
        except AlreadyCommitted:
            continue
    log.fold({"events": lambda df: df.hint("rebalance", F.col("read_date")), "ids": lambda df: df.hint("rebalance", F.col("part"))}, parts)


def write_snapshot(df: DataFrame, folder: str, name: str) -> str:
    """Write a whole table and make it current; returns its directory."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{folder}/{name}/{version}")
    fs, marker = hadoop_path(spark, f"{folder}/{name}/_current/{time.time_ns():020d}-{version}")
    fs.create(marker, False).close()
    return f"{folder}/{name}/{version}"


def read_snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    fs, markers = hadoop_path(spark, f"{folder}/{name}/_current")
    last = max(x.getPath().getName() for x in fs.listStatus(markers) if "-" in x.getPath().getName())
    return spark.read.parquet(f"{folder}/{name}/{last.split('-')[1]}")


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Insert or replace by natural key; ``changes`` holds a key once."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes)


def write_registry(rows: DataFrame, folder: str) -> str:
    return write_snapshot(conform(rows, schemas.SERIES), folder, "registry")


def read_registry(spark: SparkSession, folder: str) -> DataFrame:
    return conform(read_snapshot(spark, folder, "registry"), schemas.SERIES)


def write_covers(covers: DataFrame, current: DataFrame) -> DataFrame:
    return upsert(conform(current, schemas.COVERS), conform(covers, schemas.COVERS), "slug")


def drop_covers(current: DataFrame, slugs: DataFrame) -> DataFrame:
    """The covers but for those listed; absence from a list never removes one."""
    return current.join(slugs.select("slug"), "slug", "left_anti")


def read_replica(spark: SparkSession, folder: str, name: str, ids: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """A replica's table; pruned to columns (ids or versions first, bytes last), or only rows with these ids."""
    rows = spark.read.parquet(f"{folder}/{name}")
    if ids is not None:
        rows = rows.join(ids, ids.columns[0], "left_semi")
    return rows.select(*columns) if columns else rows
