"""Parquet tables of the lake: reads, writes, catalogue, manifest, backups, progress."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.scalar import normalize_ms
from barline.operators.series import DAY_MS
from barline.operators.upserts import merge_keep_last
from barline.session import materialize

CANDLE_SCHEMA = T.StructType(
    [
        T.StructField("instrument_id", T.StringType()),
        T.StructField("tf", T.StringType()),
        T.StructField("ts", T.LongType()),
        *[
            T.StructField(c, T.DoubleType())
            for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_volume")
        ],
        T.StructField("trades", T.LongType()),
    ]
)
# Generations kept, first dates.
RETAIN_GENERATIONS = 8
DEFAULT_START = {
    ("spot", "1m"): "2020-01-01",
    ("spot", "1h"): "2017-08-17",
    ("spot", "1d"): "2017-08-17",
    ("futures/um", "1m"): "2020-01-01",
    ("futures/um", "1h"): "2019-09-08",
    ("futures/um", "1d"): "2019-09-08",
}
CATALOG_PREFIXES = ("curated", "features")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; a missing path raises FileNotFoundError.

    With a schema no file is opened for inference, and files without columns read as
    NULL rows of that schema.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As ``read_table``, an empty frame when there is no table yet."""
    return read_table(spark, path, schema) if path_exists(spark, path) else spark.createDataFrame([], schema)


def heal_ts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Bring microsecond timestamps of old files to milliseconds."""
    return df.withColumn(ts, normalize_ms(ts))


def read_candles(spark: SparkSession, path: str, instrument_id: str | None = None, tf: str | None = None) -> DataFrame:
    """Candle rows with healed timestamps; the filters prune partitions."""
    df = read_table(spark, path, CANDLE_SCHEMA)
    if tf is not None:
        df = df.filter(F.col("tf") == tf)
    if instrument_id is not None:
        df = df.filter(F.col("instrument_id") == instrument_id)
    return heal_ts(df)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table, or with partitions only those the frame holds."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def merge_partitions(
    incoming: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str], order: Sequence[str] = ()
) -> None:
    """Merge rows into a partitioned table, rewriting only the partitions they touch.

    The stored side is cut to those partitions by a semi join on the partition columns
    (pruned at run time), merged with the batch (incoming wins), written to the run
    folder and from there over the partitions. The rest of the table is not read.
    """
    spark = incoming.sparkSession
    if path_exists(spark, path):
        stored = spark.read.schema(incoming.schema).parquet(path)
        touched = incoming.select(*partition_by).distinct()
        stored = stored.join(touched, list(partition_by), "left_semi").select(*incoming.columns)
    else:
        stored = spark.createDataFrame([], incoming.schema)
    merged = materialize(merge_keep_last(stored, incoming, keys, order), "merge")
    write_table(merged, path, partition_by)


def mirror(tables: dict[str, DataFrame], root: str, drop: Sequence[str] = ("_rowid",)) -> dict[str, int]:
    """Write every table under root; row counts are observed during the write."""
    counts: dict[str, int] = {}
    for name, df in tables.items():
        seen = Observation(f"mirror_{name}")
        df.drop(*drop).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/{name}")
        counts[name] = seen.get["n"]
    return counts


def file_details(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """key, size and modification time of every file below a path.

    Only file metadata is read (no content column is selected).
    """
    base = path.rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(base)
    )
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    key = F.regexp_replace(plain, F.lit("^" + "/" + base.split(":", 1)[-1].lstrip("/") + "/?"), F.lit(""))
    return files.select(key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def catalog(spark: SparkSession, root: str, prefixes: Sequence[str] = CATALOG_PREFIXES) -> DataFrame:
    """File details under the allowed prefixes of a lake root."""
    out = None
    for p in prefixes:
        if path_exists(spark, f"{root}/{p}"):
            part = file_details(spark, f"{root}/{p}", "*").withColumn("key", F.concat(F.lit(f"{p}/"), "key"))
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "key string, size bigint, mtime timestamp")
    return out


def dataset_hash(files: DataFrame) -> DataFrame:
    """sha256 over the sorted (key, size) list as JSON text; times and labels do not count.

    The list holds one entry per file, never table rows.
    """
    listed = F.array_sort(F.collect_list(F.struct("key", "size")))
    entry = F.transform(
        listed, lambda f: F.concat(F.lit('{"key": "'), f["key"], F.lit('", "size": '), f["size"].cast("string"), F.lit("}"))
    )
    text = F.concat(F.lit("["), F.array_join(entry, ", "), F.lit("]"))
    return files.agg(F.sha2(text, 256).alias("dataset_hash"), F.count(F.lit(1)).alias("files"))


def folder_hashes(files: DataFrame) -> DataFrame:
    """A hash tree over (key, size): folder, sha256, files below it; the root is the folder ''.

    A folder's hash covers the sorted names of what is directly in it, with the size of a file and the hash of a
    folder, so a change shows in the folders above it alone and equal folders have equal hashes. Folders are hashed
    from the deepest level up; no row holds more than one folder. Files of equal key count each.
    """
    spark = files.sparkSession
    parts = F.split("key", "/")
    depth = (F.size(parts) - 1).alias("depth")
    leaves = files.select(
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"),
        F.element_at(parts, -1).alias("name"),
        depth,
        F.concat(F.lit("file "), F.col("size").cast("string")).alias("content"),
        F.lit(1).cast("bigint").alias("files"),
    )
    leaves = materialize(leaves, "leaves")
    deepest = leaves.agg(F.max("depth")).first()[0]
    done, folders = [], None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = leaves.filter(F.col("depth") == level)
        if folders is not None:
            up = F.split("folder", "/")
            here = here.unionByName(
                folders.select(
                    F.array_join(F.slice(up, 1, F.size(up) - 1), "/").alias("folder"),
                    F.element_at(up, -1).alias("name"),
                    F.lit(level).alias("depth"),
                    F.concat(F.lit("folder "), "sha256").alias("content"),
                    "files",
                )
            )
        entry = F.concat_ws(" ", "content", F.length("name").cast("string"), "name")
        listed = F.array_join(F.array_sort(F.collect_list(entry)), "\n")
        folders = here.groupBy("folder").agg(F.sha2(listed, 256).alias("sha256"), F.sum("files").alias("files"))
        folders = materialize(folders, f"folders-{level}")
        done.append(folders)
    out = spark.createDataFrame([], "folder string, sha256 string, files bigint")
    for part in done:
        out = out.unionByName(part)
    return out


def content_hash(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of table content: row count and sum of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def write_manifest(spark: SparkSession, root: str, today: str) -> str:
    """Write the snapshot manifest of ``curated`` and return its dataset hash."""
    files = file_details(spark, f"{root}/curated").withColumn("key", F.concat(F.lit("curated/"), "key"))
    digest = dataset_hash(files).first()["dataset_hash"]
    dated = files.withColumns({"generated_at": F.lit(today), "dataset_hash": F.lit(digest)})
    for label in (today, "latest"):
        dated.write.mode("overwrite").json(f"{root}/snapshots/{label}")
    return digest


def read_dataset_hash(spark: SparkSession, root: str) -> str:
    """Hash of the latest manifest, 'unknown' before the first."""
    path = f"{root}/snapshots/latest"
    if not path_exists(spark, path):
        return "unknown"
    row = spark.read.schema("dataset_hash string").json(path).first()
    return row["dataset_hash"] if row else "unknown"


def generations(dates: DataFrame, today: str, keep: int = RETAIN_GENERATIONS, column: str = "backup_date") -> DataFrame:
    """Each backup date with its rank and whether it stays.

    Today's always stays; of the others the newest keep - 1. There is one row per
    backup run, so the ranking is over a handful of dates.
    """
    from pyspark.sql import Window as W

    others = (
        dates.select(column)
        .distinct()
        .filter(F.col(column) != today)
        .withColumn("_all", F.lit(1))
        .withColumn("rank", F.row_number().over(W.partitionBy("_all").orderBy(F.col(column).desc())).cast("bigint"))
        .drop("_all")
        .withColumn("kept", F.col("rank") <= keep - 1)
    )
    mine = dates.filter(F.col(column) == today).select(column).distinct()
    return others.unionByName(mine.withColumns({"rank": F.lit(0).cast("bigint"), "kept": F.lit(True)}))


def backup(tables: dict[str, DataFrame], root: str, today: str) -> dict[str, int]:
    """Write a dated full copy of every table and drop generations beyond the limit."""
    counts = mirror(tables, f"{root}/{today}")
    spark = next(iter(tables.values())).sparkSession
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(base)]
    dates = spark.createDataFrame([(n,) for n in names], "backup_date string")
    for row in generations(dates, today).filter(~F.col("kept")).collect():
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{row['backup_date']}"), True)
    return counts


def progress(existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Day after the newest row per key, as epoch ms."""
    day = F.floor(F.max("ts") / F.lit(DAY_MS)).cast("bigint") * DAY_MS
    return existing.groupBy(*keys).agg((day + DAY_MS).alias("from_ts"))


def incremental(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], default_start: str, until: Column | None = None
) -> DataFrame:
    """Incoming rows from the day after the newest stored row on, per key.

    A key without stored rows starts at the default date; ``until`` (exclusive)
    bounds every key. There is no daily budget, so a gap of any length is passed.
    """
    start = int(dt.datetime.fromisoformat(default_start).replace(tzinfo=dt.UTC).timestamp() * 1000)
    done = progress(existing, keys).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(and_, (incoming[k].eqNullSafe(done[f"_{k}"]) for k in keys))
    rows = incoming.join(done, same, "left").filter(F.col("ts") >= F.coalesce("from_ts", F.lit(start)))
    if until is not None:
        rows = rows.filter(F.col("ts") < until)
    return rows.select(*(incoming[c] for c in incoming.columns))


def month_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per month from start's month up to (not including) end's month."""
    first = F.trunc(start, "month")
    last = F.add_months(F.trunc(end, "month"), -1)
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).otherwise(
        F.array().cast("array<date>")
    )
    return df.withColumn("month", F.explode(months))


def archive(df: DataFrame, age_column: str, keep_after: int) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows to archive) split by age."""
    old = F.col(age_column) < keep_after
    return df.filter(~old), df.filter(old)


def archive_manifest(df: DataFrame, ts: str) -> DataFrame:
    """Count, time bounds and content fingerprint, to compare before deleting."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(ts).alias("min_ts"),
        F.max(ts).alias("max_ts"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("checksum"),
    )


def _by_partition(df: DataFrame, column: str, ts: str) -> DataFrame:
    """Count, time bounds and content fingerprint of each partition."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.groupBy(F.col(column).cast("string").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(ts).alias("min_ts"),
        F.max(ts).alias("max_ts"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("checksum"),
    )


def _copy(df: DataFrame, target: str, column: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(target)


def _agreeing(mine: DataFrame, there: DataFrame) -> DataFrame:
    """Partitions of which both sides have the same rows, bounds and content."""
    same = [mine[c].eqNullSafe(there[c]) for c in ("part", "rows", "min_ts", "max_ts", "checksum")]
    return mine.join(there, reduce(and_, same), "left_semi")


def retire(spark: SparkSession, source: str, target: str, column: str, before: str, ts: str = "ts") -> DataFrame:
    """Move the partitions of a table, partitioned by ``column``, with ``column`` < ``before`` into an archive.

    A partition is copied, read back from the archive and compared with the source by count, time bounds and content;
    only then is it dropped from the source. Partitions that the archive already holds alike are not copied again,
    so a repeat after a crash goes on where it stopped, and one that is damaged in the archive is copied once more
    as long as the source has it. Returns, per old partition of the source: part, rows, min_ts, max_ts, checksum and
    dropped. Only the names of partitions pass through the driver. Rows of a null ``column`` are never old.
    """
    table = read_table(spark, source)
    old = table.filter(F.col(column) < before)
    mine = materialize(_by_partition(old, column, ts), "old")

    def archived() -> DataFrame:
        if not path_exists(spark, target):
            return mine.limit(0)
        return _by_partition(read_table(spark, target, table.schema).filter(F.col(column) < before), column, ts)

    missing = mine.join(_agreeing(mine, archived()), "part", "left_anti")
    if missing.head(1):
        names = missing.select(F.col("part").alias("_part"))
        _copy(old.join(names, F.col(column).cast("string") == F.col("_part"), "left_semi"), target, column)
    # read back: what was written counts, not what was meant to be
    spark.catalog.refreshByPath(target)
    good = materialize(_agreeing(mine, archived()), "verified")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in good.select("part").collect():
        path = jvm.org.apache.hadoop.fs.Path(f"{source}/{column}={row['part']}")
        path.getFileSystem(conf).delete(path, True)
    spark.catalog.refreshByPath(source)
    return mine.join(good.select("part", F.lit(True).alias("dropped")), "part", "left").withColumn(
        "dropped", F.coalesce("dropped", F.lit(False))
    )
