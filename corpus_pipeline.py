"""From raw documents to token sequences: rules, near-duplicates, repeated passages, mix, packing.

Every stage takes and returns the columns of ``documents`` (doc_id, text, lang, source, n_chars), the last one
the packed pieces. Each works on all rows its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import line_rules, mixing, near_dup, packing, substring_dedup
from barline.session import materialize

#: every stage is tested against brute force; SQL can express neither the duplicates nor the packing
ORACLE_SQL = None


def _documents(df: DataFrame, text: str) -> DataFrame:
    return df.select(
        "doc_id", F.col(text).alias("text"), "lang", "source", F.char_length(text).cast("bigint").alias("n_chars")
    )


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail one."""
    edges = docs.select(F.col("doc_id").alias("edge_id"), F.col("text").alias("rationale"), "lang", "source")
    judged = line_rules.clean_lines(edges, carry=("lang", "source")).filter("kept")
    return _documents(judged.withColumnRenamed("edge_id", "doc_id"), "cleaned")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest doc_id; documents without an id stay."""
    edges = docs.select(F.col("doc_id").alias("edge_id"), F.col("text").alias("hypothesis"))
    found = near_dup.near_duplicates(edges)
    dropped = found.filter(F.col("edge_id").isNotNull() & ~F.col("kept")).select(F.col("edge_id").alias("doc_id"))
    return docs.join(dropped.distinct(), "doc_id", "left_anti").select("doc_id", "text", "lang", "source", "n_chars")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur before; the others keep their layout."""
    edges = docs.select(F.col("doc_id").alias("edge_id"), F.col("text").alias("rationale"), "lang", "source")
    cut = substring_dedup.remove_repeats(edges, carry=("lang", "source"), keep_layout=True)
    return _documents(cut.withColumnRenamed("edge_id", "doc_id"), "kept_text")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times.

    Rows that repeat a doc_id and source are taken as often as the one taken least.
    """
    edges = docs.select(
        F.col("doc_id").alias("edge_id"), F.col("source").alias("category"), F.col("text").alias("hypothesis")
    )
    mixed = mixing.mix(edges).groupBy("edge_id", "category").agg(F.min("copies").alias("copies"))
    taken = mixed.filter("copies > 0")
    same = docs["doc_id"].eqNullSafe(taken["edge_id"]) & docs["source"].eqNullSafe(taken["category"])
    times = docs.join(taken, same).withColumn("_time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return times.select("doc_id", "text", "lang", "source", "n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the mix took."""
    outputs = docs.select(F.col("doc_id").alias("output_id"), F.col("text").alias("content"))
    pieces = packing.token_pieces(outputs, packing.default_vocabulary())
    return packing.pack(pieces).withColumnRenamed("output_id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
