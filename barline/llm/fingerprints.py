"""Paragraph fingerprints of versions that subtract: invertible Bloom lookup sketches, in DataFrame operations only.

A sketch is a row of cells (count, exclusive or of digests, exclusive or of check values). Every paragraph
digest goes into one cell of each of three equal sub-tables. Cells of two sketches subtract; what both hold
cancels. A cell left with a single digest gives it away, which empties other cells in turn (peeling). If
digests stay entangled, both versions are sketched again eight times as large.

Cells are rows, and all rows of a version stay in one task: after the versions are dealt by key, neither
sketching nor peeling shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.llm.order import global_index
from barline.session import materialize

#: words of a paragraph part
PART_WORDS = 16

#: cells of the printed sketch, the first that is peeled; the next ones are eight times as large each
CELLS, GROWTH = 24, 8

#: rounds of peeling before a larger sketch is tried
ROUNDS = 6

_WORD = r"[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+"
_KEY = ["_k1", "_k2"]


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraph parts of a text, each of 16 words of a line at most."""
    parts = F.regexp_extract_all(text, F.lit(f"(?:{_WORD}){{1,{PART_WORDS}}}"), F.lit(0))
    # trailing space goes, so that a part does not depend on what follows it
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(F.rtrim(p))))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(-1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _places(key: Column, cells: int) -> list[Column]:
    """The cell of a digest in each of the three sub-tables."""
    third = cells // 3
    return [(F.pmod(F.xxhash64(key, F.lit(cells * 4 + j)), F.lit(third)) + j * third).cast("int") for j in range(3)]


def sketch(rows: DataFrame, of: list[str], cells: int) -> DataFrame:
    """Cells (cell, c, k, h) of signed digests (sign, key), by the columns ``of``; empty cells are left out.

    Digests with sign -1 are taken away, so the sketch of both versions' digests is the difference of their sketches.
    """
    placed = rows.select(*of, "sign", "key", F.explode(F.array(*_places(F.col("key"), cells))).alias("cell"))
    summed = placed.groupBy(*of, "cell").agg(
        F.sum("sign").alias("c"), F.bit_xor("key").alias("k"), F.bit_xor(_check(F.col("key"))).alias("h")
    )
    return summed.filter("c <> 0 OR k <> 0")


def _peel_once(sketches: DataFrame, of: list[str], cells: int, keep: bool) -> DataFrame:
    """Take the digests that stand alone in a cell out of all their cells.

    Cell -1 adds up what was taken: a row for each digest (got) and its sign (c) to ``keep`` them, else their number.
    """
    c, k, h = F.col("c"), F.col("k"), F.col("h")
    single = (F.col("cell") >= 0) & (F.abs(c) == 1) & (h == _check(k))
    row = lambda cell, c, k, h, taken: F.struct(
        cell.alias("cell"), c.alias("c"), k.alias("k"), h.alias("h"), taken.alias("taken")
    )
    zero = F.lit(0).cast("bigint")
    itself = F.array(row(F.col("cell"), c, k, h, F.col("got")))
    out = [row(place, -c, k, h, k) for place in _places(k, cells)]
    out.append(row(F.lit(-1), c if keep else F.lit(1).cast("bigint"), zero, zero, k))
    rows = sketches.select(*of, F.explode(F.when(single, F.concat(itself, F.array(*out))).otherwise(itself)).alias("r"))
    # a digest may stand alone in several cells, but is taken out once
    once = rows.groupBy(*of, F.col("r.cell").alias("cell"), F.col("r.taken").alias("taken")).agg(
        F.max("r.c").alias("c"), F.max("r.k").alias("k"), F.max("r.h").alias("h")
    )
    got = F.when(F.col("cell") == -1, F.col("taken")) if keep else F.lit(None).cast("bigint")
    left = once.groupBy(*of, "cell", got.alias("got")).agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return left.filter("c <> 0 OR k <> 0")


def _peeled(rows: DataFrame, of: list[str], cells: int, keep: bool) -> DataFrame:
    sketches = sketch(rows, of, cells).withColumn("got", F.lit(None).cast("bigint"))
    for _ in range(ROUNDS):
        sketches = _peel_once(sketches, of, cells, keep)
    return sketches


def peel(rows: DataFrame, of: list[str], cells: int) -> DataFrame:
    """By the columns ``of``: differing (how many digests peeling recovered) and left (cells still entangled).

    ``rows`` are signed digests; those without any difference give no row.
    """
    counter = F.col("cell") == -1
    return _peeled(rows, of, cells, keep=False).groupBy(*of).agg(
        F.coalesce(F.sum(F.when(counter, F.col("c"))), F.lit(0)).alias("differing"),
        F.count(F.when(~counter, 1)).alias("left"),
    )


def recover(rows: DataFrame, of: list[str], cells: int) -> DataFrame:
    """The digests that peeling recovers, as (of, sign, digest); rows of entangled cells have neither sign nor digest."""
    taken = F.col("cell") == -1
    return _peeled(rows, of, cells, keep=True).select(
        *of, F.when(taken, F.col("c")).alias("sign"), F.when(taken, F.col("got")).alias("digest")
    )


def _signed(keys: DataFrame) -> DataFrame:
    """Signed digests of the pairs (own, edited) and (own, next) of every version, dealt by key."""
    sign = lambda of, s: F.transform(of, lambda k: F.struct(F.lit(s).cast("bigint").alias("sign"), k.alias("key")))
    pair = lambda n, other: F.struct(F.lit(n).alias("pair"), F.concat(sign("_own", 1), sign(other, -1)).alias("all"))
    pairs = keys.select(*_KEY, F.explode(F.array(pair(0, "_edited"), pair(1, "_next"))).alias("p"))
    return pairs.select(*_KEY, F.col("p.pair").alias("pair"), F.explode("p.all").alias("d")).select(
        *_KEY, "pair", "d.sign", "d.key"
    )


def _attempts(keys: DataFrame, keep: bool = False) -> Iterator[DataFrame]:
    """What peeling gives for the pairs that peel, size after size, until all have.

    (key, pair, differing), or to ``keep`` the digests (key, pair, sign, digest).
    """
    cells, open_pairs = CELLS, None
    while True:
        of = [*_KEY, "pair"]
        dealt = keys if open_pairs is None else keys.join(open_pairs.select(*_KEY).distinct(), _KEY, "left_semi")
        signed = _signed(_dealt(dealt))
        if open_pairs is not None:
            signed = signed.join(_dealt(open_pairs), of, "left_semi")
        if keep:
            tried = materialize(recover(signed, of, cells), "recovered")
            open_pairs = tried.filter("digest IS NULL").select(*of).distinct()
            yield tried.join(open_pairs, of, "left_anti")
        else:
            tried = materialize(peel(signed, of, cells), "peeled")
            yield tried.filter("left = 0").select(*of, "differing")
            open_pairs = tried.filter("left > 0").select(*of)
        if not open_pairs.head(1):
            return
        cells *= GROWTH


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by key. The column list must be the same wherever an exchange is to be made once and read twice."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_KEY)


def printed(keys: DataFrame) -> DataFrame:
    """The smallest sketches as text: the number of digests, then the filled cells in hexadecimal."""
    versions = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("_own").alias("all")), F.struct(F.lit(1).alias("which"), F.col("_edited").alias("all"))))
    rows = _dealt(keys.select(*_KEY, "_own", "_edited")).select(*_KEY, versions.alias("v"))
    rows = rows.select(*_KEY, "v.which", F.explode("v.all").alias("key"))
    cells = sketch(rows.withColumn("sign", F.lit(1).cast("bigint")), [*_KEY, "which"], CELLS)
    text = F.concat_ws(".", F.hex(F.col("cell").cast("bigint")), F.hex("c"), F.hex("k"), F.hex("h"))
    of = lambda which: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("which") == which, F.struct("cell", text.alias("t"))))), lambda x: x["t"]), "-"
    )
    return cells.groupBy(*_KEY).agg(of(0).alias("_print"), of(1).alias("_print_edited"))


def _versions(versions: DataFrame) -> DataFrame:
    """Every row with its size, the digest of its edited text, and the digests of it, its edit and its successor.

    Texts are exchanged once, by a hash of the row, and read twice: first for the beginnings that predecessors ask for
    (a third of their own length at most) with the digests of the whole text, then for the edits. Columns: version_id,
    next_id, the key, n_chars, edited_sha256, _own, _edited, _next, and _copy, which numbers identical rows from 1.
    """
    rows = versions.select("version_id", F.coalesce(F.col("changelog").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("version_id", "text", F.xxhash64("version_id", "text").alias("_k1"), F.hash("version_id", "text").alias("_k2"))
    names = rows.select("version_id", *_KEY, F.char_length("text").cast("bigint").alias("_n")).distinct()
    ranked = global_index(names, [F.col("version_id"), F.col("_k1"), F.col("_k2")], "_rank")
    ranked = materialize(ranked, "ranks")
    total = max(1, ranked.count())
    successor = ranked.select(F.col("_rank"), F.col("_k1").alias("_n1"), F.col("_k2").alias("_n2"))
    wanted = ranked.withColumn("_rank", F.pmod(F.col("_rank") - 1, F.lit(total)))
    wanted = wanted.join(successor, "_rank").select(*_KEY, F.floor(F.col("_n") / 3).cast("int").alias("_cut"), "_n1", "_n2")
    wanted = materialize(wanted, "successors")

    # version_id is carried in both readings, so that both are of the same exchange
    texts = _dealt(rows)
    follows = texts.select(F.col("version_id").alias("next_id"), F.col("_k1").alias("_n1"), F.col("_k2").alias("_n2"), "text")
    follows = follows.join(wanted, ["_n1", "_n2"]).select(
        *_KEY, "next_id", F.expr("substring(text, 1, _cut)").alias("_start"), digests(F.col("text")).alias("_next")
    )
    n = F.char_length("text").cast("bigint")
    kept = F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) AS int))")
    joined = texts.join(follows.dropDuplicates(_KEY), _KEY).select(
        "version_id", "next_id", *_KEY, n.alias("n_chars"), F.concat(kept, "_start").alias("edited"), digests(F.col("text")).alias("_own"), "_next"
    )
    joined = joined.select(
        "version_id", "next_id", *_KEY, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "_own", digests(F.col("edited")).alias("_edited"), "_next"
    )
    copy = F.row_number().over(W.partitionBy(*_KEY).orderBy(*_KEY))
    return materialize(joined.withColumn("_copy", copy), "digests")


def differences(versions: DataFrame) -> DataFrame:
    """The paragraph digests in which versions differ, as peeling the subtracted sketches recovers them.

    ``versions`` as in ``fingerprints``. Rows (version_id, next_id, pair, sign, digest): pair is ``edited`` or ``next``, sign is 1
    for a digest of the version alone and -1 for one of the other text alone. Pairs without a difference give no row, and
    identical rows count as one version.
    """
    joined = _versions(versions).filter("_copy = 1")
    found = None
    for part in _attempts(joined.select(*_KEY, "_own", "_edited", "_next"), keep=True):
        found = part if found is None else found.unionByName(part)
    pair = F.when(F.col("pair") == 0, "edited").otherwise("next")
    return joined.select("version_id", "next_id", *_KEY).join(found, _KEY).select(
        "version_id", "next_id", pair.alias("pair"), "sign", "digest"
    )


def fingerprints(versions: DataFrame) -> DataFrame:
    """Fingerprint every version's changelog, an edited form of it and its successor's, and compare them.

    ``versions`` needs version_id and changelog; other columns are not read. One row for each row: version_id,
    n_chars, edited_sha256 (of the changelog with its last third, rounded down, replaced by the first as many code
    points of the next version's, or all of it), fingerprint, edited_fingerprint, near_edited and near_next (the share of
    digests that both hold, 0 to 1, by the differing ones that peeling recovers; 1 for two texts without words) and next_id.
    The next version has the next smaller version_id; after the smallest comes the largest. Null changelogs are empty. Rows that
    repeat an id stand in the order of a hash of their texts; identical rows count as one version. A single version follows itself.
    """
    joined = _versions(versions)
    keys = joined.filter("_copy = 1").select(*_KEY, "_own", "_edited", "_next")

    peeled = None
    for part in _attempts(keys):
        peeled = part if peeled is None else peeled.unionByName(part)
    differing = lambda n: F.coalesce(F.sum(F.when(F.col("pair") == n, F.col("differing"))), F.lit(0))
    counted = peeled.groupBy(*_KEY).agg(differing(0).alias("_d_edited"), differing(1).alias("_d_next"))
    prints = printed(keys)
    sizes = joined.select(
        "version_id", "next_id", *_KEY, "n_chars", "edited_sha256", F.size("_own").alias("_a"), F.size("_edited").alias("_e"), F.size("_next").alias("_x")
    )

    def near(other: str, d: str) -> Column:
        both = F.col("_a") + F.col(other)
        return F.when(both == 0, F.lit(1.0)).otherwise(1 - F.coalesce(F.col(d), F.lit(0)) / both)

    def text(size: str, cells: str) -> Column:
        return F.concat_ws(":", F.col(size).cast("string"), F.coalesce(F.col(cells), F.lit("")))

    return sizes.join(counted, _KEY, "left").join(prints, _KEY, "left").select(
        "version_id",
        "n_chars",
        "edited_sha256",
        text("_a", "_print").alias("fingerprint"),
        text("_e", "_print_edited").alias("edited_fingerprint"),
        near("_e", "_d_edited").alias("near_edited"),
        near("_x", "_d_next").alias("near_next"),
        "next_id",
    )
