"""Removal of long passages that occur before, found by fixed-block anchors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barline.llm.text import mix, utf8, window_hashes, word_hashes
from barline.session import materialize

WINDOW_WORDS = 20
#: any window holds a whole block at a multiple of this width
BLOCK_WORDS = 10

#: text that one task holds at once, and hashes that one task compares
CHUNK_BYTES = 8 << 20
BUCKET_HASHES = 1 << 20

_U32 = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, which shuffle compression shortens if they are sorted or small."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _numbers(planes: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes) >> _U32) * np.uint64(buckets) >> _U32


def _parts(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of a sorted array."""
    edges = np.flatnonzero(np.diff(buckets)) + 1
    starts = [0, *edges.tolist(), len(buckets)] if len(buckets) else []
    for lo, hi in zip(starts, starts[1:]):
        yield int(buckets[lo]), lo, hi


def _rows(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(names.items())})


_PROBES = {"bucket": pa.int32(), "chunk": pa.int64(), "hashes": pa.binary(), "anchors": pa.binary(), "twice": pa.binary()}
_HITS = {"chunk": pa.int64(), "bucket": pa.int32(), "hashes": pa.binary()}


def _probe(buckets: int):
    """The distinct hashes of all rolling blocks of a chunk's texts, by bucket; those at block boundaries marked."""

    def emit(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for chunk, arrays in held.items():
            aligned = np.concatenate([np.arange(len(a)) % BLOCK_WORDS == 0 for a in arrays])
            hashes, back, counts = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
            anchor = np.zeros(len(hashes), bool)
            anchor[back[aligned]] = True
            keys = _bucket(hashes, buckets) << _U32 | hashes & _LOW
            order = np.argsort(keys)
            keys, anchor, twice = keys[order], anchor[order], counts[order] > 1
            rows = [
                (b, chunk, _planes(keys[lo:hi].astype(np.uint32)), np.packbits(anchor[lo:hi]).tobytes(), np.packbits(twice[lo:hi]).tobytes())
                for b, lo, hi in _parts(keys >> _U32)
            ]
            yield from _rows(_PROBES, rows).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        total = 0
        for batch in batches:
            for chunk, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                words = (text or b"").split()
                if len(words) >= WINDOW_WORDS:
                    held.setdefault(chunk, []).append(window_hashes(word_hashes(words), BLOCK_WORDS))
                    total += len(words)
                if total > 6_000_000:
                    yield from emit(held)
                    held, total = {}, 0
        yield from emit(held)

    return run


def _hot_blocks(probes: pa.Table) -> pa.Table:
    """Of each chunk, the hashes that are a block somewhere and occur at least twice."""
    bucket = probes.column("bucket")[0].as_py()
    chunks = probes.column("chunk").to_pylist()
    lists = [_numbers(x, np.uint32) for x in probes.column("hashes").to_pylist()]
    bits = lambda name: [
        np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(probes.column(name).to_pylist(), lists)
    ]
    hashes, back, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    often = counts > 1
    often[back[np.concatenate(bits("twice"))]] = True
    block = np.zeros(len(hashes), bool)
    block[back[np.concatenate(bits("anchors"))]] = True
    hot = (often & block)[back]
    owner = np.repeat(np.array(chunks), [len(h) for h in lists])[hot]
    values = np.concatenate(lists)[hot]
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    return _rows(_HITS, [(c, bucket, _planes(np.unique(values[lo:hi]))) for c, lo, hi in _parts(owner)])


class _Chunk:
    """The texts of a chunk in the order of the rows, as words and as one array of window hashes."""

    def __init__(self, table: pa.Table):
        texts = utf8(table.column("text").combine_chunks())
        ids, digests = table.column("edge_id").to_pylist(), table.column("digest").to_pylist()
        # null ids come last; rows of one id stand in the order of their digests
        order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i], digests[i]))
        self.order = np.array(order, np.int64)
        self.words = [(texts[i] or b"").split() for i in order]
        self.starts = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)

    def windows(self, *widths: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each width: hash and place, in the chunk's words, of every run of words within one text."""
        found: list[tuple[list, list]] = [([np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]) for _ in widths]
        for start, words in zip(self.starts.tolist(), self.words):
            if len(words) >= WINDOW_WORDS:
                own = word_hashes(words)
                for width, (hashes, places) in zip(widths, found):
                    hashes.append(window_hashes(own, width))
                    places.append(np.arange(start, start + len(hashes[-1])))
        return [(np.concatenate(h), np.concatenate(p)) for h, p in found]


def _extend(buckets: int, candidates: T.StructType):
    """Windows around the hit blocks of a chunk: each distinct hash with the text that holds it first."""
    schema = to_arrow_schema(candidates)

    def run(texts: pa.Table, hits: pa.Table) -> pa.Table:
        if not texts.num_rows or not hits.num_rows:
            return schema.empty_table()
        chunk = _Chunk(texts)
        (blocks, at), (whole, places) = chunk.windows(BLOCK_WORDS, WINDOW_WORDS)
        hot = [
            _numbers(h, np.uint32).astype(np.uint64) | np.uint64(b) << _U32
            for b, h in zip(hits.column("bucket").to_pylist(), hits.column("hashes").to_pylist())
        ]
        hit = np.isin(_bucket(blocks, buckets) << _U32 | blocks & _LOW, np.concatenate(hot))
        # a window holds the blocks that start 0 to 10 words after it
        seen = np.zeros(int(chunk.starts[-1]) + 1, np.int64)
        seen[at[hit] + 1] = 1
        seen = np.cumsum(seen)
        near = seen[places + WINDOW_WORDS - BLOCK_WORDS + 1] > seen[places]
        hashes, first = np.unique(whole[near], return_index=True)
        text = np.searchsorted(chunk.starts, places[near][first], side="right") - 1
        bucket = _bucket(hashes, buckets)
        order = np.argsort(bucket, kind="stable")
        hashes, text, bucket = hashes[order], text[order], bucket[order]
        number = texts.column("chunk")[0].as_py()
        ids, digests = texts.column("edge_id").to_pylist(), texts.column("digest").to_pylist()
        rows = []
        for b, lo, hi in _parts(bucket):
            used, local = np.unique(text[lo:hi], return_inverse=True)
            used = chunk.order[used].tolist()
            rows.append(
                {
                    "bucket": b,
                    "chunk": number,
                    "hashes": _planes(hashes[lo:hi]),
                    "texts": _planes(local.astype(np.uint32)),
                    "ids": [ids[k] for k in used],
                    "digests": [digests[k] for k in used],
                }
            )
        return pa.Table.from_pylist(rows, schema)

    return run


def _later(found: pa.Table) -> pa.Table:
    """Of each chunk, the window hashes that a text of another chunk holds before."""
    bucket = found.column("bucket")[0].as_py()
    lists = [_numbers(x, np.uint64) for x in found.column("hashes").to_pylist()]
    ids, digests = found.column("ids").combine_chunks().flatten(), found.column("digests").combine_chunks().flatten()
    by_id = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
    _, rank = np.unique(np.stack([by_id.astype(np.int64), digests.to_numpy()]), axis=1, return_inverse=True)
    base = np.concatenate([[0], np.cumsum([len(x) for x in found.column("ids").to_pylist()])])
    local = [_numbers(x, np.uint32) for x in found.column("texts").to_pylist()]
    rank = np.concatenate([rank.ravel()[base[k] + x] for k, x in enumerate(local)])
    hashes = np.concatenate(lists)
    _, back = np.unique(hashes, return_inverse=True)
    least = np.full(back.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, back, rank)
    late = rank > least[back]
    owner = np.repeat(np.array(found.column("chunk").to_pylist()), [len(h) for h in lists])[late]
    hashes = hashes[late]
    return _rows(_HITS, [(int(owner[lo]), bucket, _planes(hashes[lo:hi])) for _, lo, hi in _parts(owner)])


def _cut(result: T.StructType, keep_layout: bool):
    """Take out of a chunk's texts all words of windows that occur before."""
    schema = to_arrow_schema(result)

    def run(texts: pa.Table, late: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        chunk = _Chunk(texts)
        ((whole, places),) = chunk.windows(WINDOW_WORDS)
        again = np.ones(len(whole), bool)
        again[np.unique(whole, return_index=True)[1]] = False  # the first of the chunk
        if late.num_rows:
            again |= np.isin(whole, np.concatenate([_numbers(h, np.uint64) for h in late.column("hashes").to_pylist()]))
        edges = np.zeros(int(chunk.starts[-1]) + 1, np.int64)
        edges[places[again]] += 1
        edges[places[again] + WINDOW_WORDS] -= 1
        stays = np.cumsum(edges)[:-1] == 0
        raw = utf8(texts.column("text").take(pa.array(chunk.order)).combine_chunks()) if keep_layout else None
        kept, removed = [], []
        for k, words in enumerate(chunk.words):
            own = stays[chunk.starts[k] : chunk.starts[k + 1]]
            removed.append(int(len(words) - own.sum()))
            if removed[-1]:
                kept.append(b" ".join(compress(words, own.tolist())))
            else:
                kept.append(raw[k] if keep_layout else b" ".join(words))
        return pa.Table.from_arrays(
            [
                texts.column("edge_id").take(pa.array(chunk.order)).combine_chunks(),
                pa.array([len(w) for w in chunk.words], pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
                *(texts.column(c).take(pa.array(chunk.order)).combine_chunks() for c in schema.names[4:]),
            ],
            schema=schema,
        )

    return run


def remove_repeats(edges: DataFrame, carry: tuple[str, ...] = (), keep_layout: bool = False) -> DataFrame:
    """Remove from every rationale the passages of 20 words or more that occur before.

    ``edges`` needs edge_id and rationale; the columns named in ``carry`` go with the rows, others are not
    read. One row for each row: edge_id, n_words, n_removed, kept_text (the words that stay, joined by one
    space; with ``keep_layout``, texts that lose nothing stay as they are) and the carried columns. A window is 20 consecutive words of one text; its words go if the same
    words also start earlier: in a smaller edge_id, or earlier in the same text. Windows are judged on the
    input. Null rationales have no words. Rows that repeat an edge_id stand in the order of a hash of their
    texts (identical rows in any order), null ids after all others.

    Blocks of ten words at multiples of ten are the index; every rolling block of ten probes it. A block that
    is hit is extended by all windows around it, whose first places decide. A task sends every hash
    once, so one passage in a third of all texts costs a row per task; texts are dealt by hash into chunks of
    about 8 MB, which only receive hashes of their own.
    """
    rows = edges.select(
        "edge_id", F.col("rationale").cast("string").alias("text"), *carry
    ).withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / CHUNK_BYTES))
    buckets = max(1, math.ceil(size / 6 / BUCKET_HASHES))  # a word and its space are six bytes or more in most texts
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("edge_id", "digest"), F.lit(chunks)))

    def ddl(columns: dict) -> str:
        names = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary"}
        return ", ".join(f"{n} {names[t]}" for n, t in columns.items())

    probes = rows.select("chunk", "text").mapInArrow(_probe(buckets), ddl(_PROBES))
    hits = materialize(probes.groupBy("bucket").applyInArrow(_hot_blocks, ddl(_HITS)), "hits")

    id_type = rows.schema["edge_id"].dataType
    candidates = T.StructType(
        [
            T.StructField("bucket", T.IntegerType()),
            T.StructField("chunk", T.LongType()),
            T.StructField("hashes", T.BinaryType()),
            T.StructField("texts", T.BinaryType()),
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("digests", T.ArrayType(T.LongType())),
        ]
    )
    texts = rows.select("chunk", "edge_id", "digest", "text")
    windows = texts.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extend(buckets, candidates), candidates)
    late = materialize(windows.groupBy("bucket").applyInArrow(_later, ddl(_HITS)), "late")

    result = T.StructType(
        [
            T.StructField("edge_id", id_type),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
            *(edges.schema[c] for c in carry),
        ]
    )
    whole = rows.select("chunk", "edge_id", "digest", "text", *carry)
    return whole.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInArrow(_cut(result, keep_layout), result)
