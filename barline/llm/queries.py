"""The text operators over the given tables: thin queries, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import (
    alignment,
    archives,
    fingerprints,
    hard_negatives,
    language_id,
    licenses,
    line_rules,
    mixing,
    near_dup,
    packing,
    quality_model,
    sharding,
    substring_dedup,
)
from barline.session import run_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL any engine can check it by."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    outputs = table(spark, sf, "documents").select(F.col("doc_id").alias("output_id"), F.col("text").alias("content"))
    pieces = packing.token_pieces(outputs, packing.default_vocabulary())
    return packing.pack(pieces).withColumnRenamed("output_id", "doc_id")


@query("op1_near_dup")
def op1_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "documents").select(F.col("doc_id").alias("edge_id"), F.col("text").alias("hypothesis"))
    return near_dup.near_duplicates(edges).withColumnRenamed("edge_id", "doc_id")


_SQL_WORD = r"[^\x20\x09-\x0D]+"


def _line_sql() -> str:
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    # a separator's trailing space is also the next one's leading space: double the spaces before counting
    rules = [
        f"NOT regexp_matches(line, {quoted(line_rules.SENTENCE_END)})",
        "2 * (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) + len(regexp_extract_all(line, '!!'))) >= n",
        rf"len(regexp_extract_all(regexp_replace(line, '([\x20\x09-\x0D])', '\1\1', 'g'), {quoted(line_rules.SEPARATOR)})) >= 2",
        "length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 12 AND 2 * length(regexp_replace(line, '[^A-Z]', '', 'g')) > length(regexp_replace(line, '[^A-Za-z]', '', 'g'))",
        f"regexp_matches(line, {quoted(line_rules.BOILERPLATE)})",
    ]
    case = "CASE " + " ".join(f"WHEN {r} THEN {k}" for k, r in enumerate(rules)) + " ELSE -1 END"
    lost = ", ".join(f"CAST(sum(CASE WHEN rule = {k} THEN n ELSE 0 END) AS BIGINT) AS lost_{r}" for k, r in enumerate(line_rules.RULES))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_SQL_WORD}') AS words FROM documents),
lines AS (SELECT doc_id, line, len(regexp_extract_all(line, '{_SQL_WORD}')) AS n, pos
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
judged AS (SELECT *, {case} AS rule, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth FROM lines WHERE n > 0),
byline AS (SELECT doc_id, CAST(sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_dup_lines, {lost} FROM judged GROUP BY 1),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
g AS (SELECT *, CASE WHEN count(*) OVER f = 5 THEN list(word) OVER f END AS run FROM w
      WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
t AS (SELECT doc_id, pos, run IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, run) > 1 AS again FROM g),
covered AS (SELECT doc_id, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS yes FROM t),
rep AS (SELECT doc_id, CAST(sum(yes) AS BIGINT) AS n_repeat_words FROM covered GROUP BY 1),
f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        {", ".join(f"coalesce(lost_{r}, 0) AS lost_{r}" for r in line_rules.RULES)}
      FROM d LEFT JOIN byline USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
  AND 100 * ({" + ".join(f"lost_{r}" for r in line_rules.RULES)}) <= {line_rules.MAX_LOST} * n_words AS kept
FROM f"""


@query("op5_quality_rules", _line_sql())
def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "documents").select(F.col("doc_id").alias("edge_id"), F.col("text").alias("rationale"))
    return line_rules.clean_lines(edges).drop("cleaned").withColumnRenamed("edge_id", "doc_id")


MIX_SQL = rf"""
WITH r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SQL_WORD}')) AS BIGINT) AS size,
             md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, row_number() OVER p AS k, (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER q, 0) AS num,
        sum(weight) OVER () - coalesce(sum(weight) OVER q, 0) AS den
      FROM w WINDOW p AS (ORDER BY 3.0 * source_size / weight, n),
                    q AS (ORDER BY 3.0 * source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT num, den FROM o WHERE num * weight <= 3 * source_size * den ORDER BY k LIMIT 1),
t AS (SELECT source, n, source_size, CASE WHEN 3 * source_size * den < num * weight THEN CAST(3 * source_size AS DOUBLE)
        ELSE CAST(num * weight AS DOUBLE) / CAST(den AS DOUBLE) END AS target FROM w, cut),
c AS (SELECT r.*, t.n, t.source_size, t.target, sum(r.size) OVER (PARTITION BY t.n ORDER BY r.h, r.size, r.doc_id ROWS UNBOUNDED PRECEDING) AS red
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source WHERE r.size > 0),
e AS (SELECT *, CAST(p * source_size + red AS DOUBLE) / target AS finish FROM c, (VALUES (0), (1), (2)) AS v(p)),
q AS (SELECT doc_id, sum(size) OVER (ORDER BY finish, n, p, h, size, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM e),
k AS (SELECT doc_id, count(*) AS copies FROM q WHERE total <= (SELECT sum(size) FROM r) GROUP BY 1)
SELECT r.doc_id, r.source, r.size, t.source_size, t.target, CAST(coalesce(copies, 0) AS BIGINT) AS copies,
  CAST(coalesce(copies, 0) * r.size AS BIGINT) AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source LEFT JOIN k USING (doc_id)"""


@query("op3_mixing", MIX_SQL)
def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "documents").select(
        F.col("doc_id").alias("edge_id"), F.col("source").alias("category"), F.col("text").alias("hypothesis")
    )
    return mixing.mix(edges).withColumnsRenamed({"edge_id": "doc_id", "category": "source"})


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "documents").select(F.col("doc_id").alias("edge_id"), F.col("text").alias("rationale"))
    return substring_dedup.remove_repeats(edges).select(
        F.col("edge_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("payload"))
    return sharding.shard(events).select(
        F.col("event_id").alias("doc_id"),
        "size",
        F.col("payload_crc32").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS least FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > least THEN least END AS refers_to
FROM f"""


@query("op2_warc", WARC_SQL)
def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "pages").select(
        F.col("page_id").alias("event_id"),
        "url",
        # any minute of about 95 years, whatever the id is
        (F.pmod("page_id", F.lit(50_000_000).cast("bigint")) * 60_000).alias("ts"),
        F.col("html").alias("payload"),
    )
    arc, warc = run_dir(spark, "arc"), run_dir(spark, "warc")
    # both versions of the legacy format are read back
    archives.write_arc(events.filter("event_id IS NULL OR event_id % 2 = 0"), f"{arc}/v1", 1)
    archives.write_arc(events.filter("event_id % 2 <> 0"), f"{arc}/v2", 2)
    archives.write_warc(archives.convert_arc(spark, f"{arc}/v*", "bigint"), warc)
    records = archives.read_warc(spark, warc, "bigint").filter(F.col("type").isin("response", "revisit"))
    return records.select(
        F.col("event_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"
    )


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    versions = table(spark, sf, "documents").select(F.col("doc_id").alias("version_id"), F.col("text").alias("changelog"))
    return fingerprints.fingerprints(versions).select(
        F.col("version_id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query("op9_quality_model")
def op9_quality_model(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "documents").select(F.col("doc_id").alias("edge_id"), "lang", F.col("text").alias("hypothesis"))
    trusted = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("edge_id"))
    return quality_model.classify(edges, trusted, folded=False).withColumnRenamed("edge_id", "doc_id")


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every page and of every document, a document's source standing for its host."""
    docs, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    models = language_id.train(docs.select("lang", F.col("text").alias("hypothesis")))
    none = F.lit(None).cast("bigint")
    captures = pages.select(
        F.col("page_id").alias("event_id"), none.alias("doc_id"), F.col("page_id"), "url", F.col("html").alias("payload")
    ).unionByName(
        docs.select(
            F.col("doc_id").alias("event_id"),
            "doc_id",
            none.alias("page_id"),
            F.concat(F.lit("source://"), F.col("source")).alias("url"),
            F.col("text").alias("payload"),
        )
    )
    return language_id.identify(captures, models, carry=("doc_id", "page_id")).drop("event_id")


def _license_sql(block: int = 64, stride: int = 32) -> str:
    def words(t: licenses.Template, distinct: bool) -> str:
        return "[" + ", ".join(f"'{w}'" for w in (dict.fromkeys(t.words) if distinct else t.words)) + "]"

    rows = ", ".join(
        f"('{t.label}', {t.phrase}, {100 if t.phrase else t.percent}, {words(t, True)}, {words(t, False)})" for t in licenses.TEMPLATES
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT * FROM (VALUES {rows}) AS v(label, phrase, percent, members, words)),
b AS (SELECT r, unnest(range(CAST(greatest(0, ceil((len(w) - {block}) / {stride})) AS BIGINT) + 1)) AS k, w FROM d),
s AS (SELECT r, list_distinct(w[k * {stride} + 1 : k * {stride} + {block}]) AS held FROM b),
m AS (SELECT r, label, max(len(list_intersect(held, members)) / len(members)) AS share FROM s, t
      WHERE NOT phrase AND 100 * len(list_intersect(held, members)) >= percent * len(members) GROUP BY 1, 2),
p AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(words)] = words)) AS place FROM d, t WHERE phrase),
f AS (SELECT r, label, true AS base, 1.0 AS share, count(*) AS n, min(place) AS lo, max(place) AS hi FROM p GROUP BY 1, 2
      UNION ALL SELECT r, label, false, share, 0, NULL, NULL FROM m)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_base,
  CAST(min(lo) AS BIGINT) AS first_word, CAST(max(hi) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(CAST(max(share) AS DOUBLE), 0) AS score
FROM d LEFT JOIN f USING (r) GROUP BY r"""


@query("op13_license_scan", _license_sql())
def op13_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    outputs = table(spark, sf, "documents").select(F.col("doc_id").alias("output_id"), F.col("text").alias("content"))
    return licenses.scan(outputs).withColumnRenamed("output_id", "doc_id")


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    outputs = table(spark, sf, "documents").select(F.col("doc_id").alias("output_id"), F.col("text").alias("content"))
    names = {"output_id": "doc_id", "n_first": "n_a", "n_second": "n_b"}
    return alignment.align(outputs, *alignment.default_vocabularies()).withColumnsRenamed(names)


_HARD_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.r AS o, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id NULLS LAST) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.r, p.o ORDER BY s.score DESC, s.id NULLS LAST) AS rank
      FROM p JOIN s ON p.r = s.r AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


@query("op11_hard_negatives", _HARD_SQL)
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    snapshots = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("ts"),
        F.col("embedding").alias("features"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("regime"),
    )
    names = {"anchor_ts": "anchor_id", "positive_ts": "positive_id", "negative_ts": "negative_id"}
    return hard_negatives.hard_negatives(snapshots, F.col("ts") % 50 == 0).withColumnsRenamed(names)
