"""Two tokenizations of the same texts, aligned byte by byte and scored by how often their ids meet."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.llm.text import mix, slices
from barline.session import materialize

#: distinct chunks that a task keeps encoded
CACHE_CHUNKS = 400_000

#: pairs that one hash function indexes, on average
SHARD_PAIRS = 1 << 16

#: rows of (pair, count) that one dense vector takes in
LEAF_ROWS = 1 << 18

#: dense vectors that one step of the tree adds up
FAN = 16

#: bytes of text whose links one task looks up
GROUP_BYTES = 1 << 24

# The pre-token pattern of byte-level vocabularies; other libraries agree on it for the characters of PLAIN
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ȳΑ-ΡЀ-ҁ]+")

_SPACE_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def default_vocabularies() -> tuple[str, str]:
    """Paths of a public byte-level vocabulary and a public piece model, installed beside their package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies write for it."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(other)}


class _First:
    """The byte-level vocabulary: ids of texts that begin with a space."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        letters, vocabulary = _byte_letters(), self.whole.get_vocab(with_added_tokens=False)
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        self.bytes: list[bytes | None] = [None] * (1 + max(vocabulary.values(), default=0))
        for token, number in vocabulary.items():
            if token not in special:
                self.bytes[number] = bytes(letters[c] for c in token)
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        # ids that follow the merges are ranks, which a faster library takes
        self.quick = None
        if [vocabulary.get(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs))):
            ranks = {b: k for k, b in enumerate(self.bytes) if b is not None}
            self.quick = tiktoken.Encoding("first", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, chunks: list[str]) -> list[list[int]]:
        if self.quick is None:
            return [e.ids for e in self.whole.encode_batch([" " + c for c in chunks], add_special_tokens=False)]
        out = [self.quick(" " + c) if PLAIN.fullmatch(c) else None for c in chunks]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(rest, self.whole.encode_batch([" " + chunks[k] for k in rest], add_special_tokens=False)):
            out[k] = e.ids
        return out


class _Second:
    """The piece model, which puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes | None] = []
        for k in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(k)
            if self.model.is_byte(k):
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            else:
                special = self.model.is_control(k) or self.model.is_unknown(k)
                self.bytes.append(None if special else piece.replace("▁", " ").encode())
        # no piece reaches over a space that follows another character: texts fall apart there
        self.local = not any(b and b" " in b.lstrip(b" ") for b in self.bytes)

    def __call__(self, chunks: list[str]) -> list[list[int]]:
        return self.model.encode(chunks, num_threads=1)


@lru_cache(maxsize=2)
def _vocabularies(first: str, second: str) -> tuple[_First, _Second]:
    """Two vocabularies for all tasks of a Python worker."""
    return _First(first), _Second(second)


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _spelt(ids: np.ndarray, counts: np.ndarray, table: list[bytes | None], sizes: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Which of the texts their ids spell back byte by byte; ids without bytes (size 0) spell nothing."""
    at, size = _starts(counts), sizes[ids]
    ends = np.append(0, np.cumsum(size))[at]
    good = np.diff(ends) == np.fromiter(map(len, raw), np.int64, len(raw))
    good &= np.diff(np.append(0, np.cumsum(size == 0))[at]) == 0
    # of equal sizes one by one, the texts are equal if all are, one after the other
    parts = list(map(table.__getitem__, ids[np.repeat(good, counts)].tolist()))
    if b"".join(parts) != b"".join([t for t, g in zip(raw, good.tolist()) if g]):
        at = at.tolist()
        for k in np.flatnonzero(good).tolist():
            good[k] = b"".join([table[i] for i in ids[at[k] : at[k + 1]].tolist()]) == raw[k]
    return good


class Aligner:
    """Aligns texts chunk by chunk; equal chunks are encoded once while they are at hand.

    A text is cut at every single space between other characters, where no token of either vocabulary reaches over.
    Each chunk has its token numbers, its groups and its links, as (first id << 32 | second id).
    """

    def __init__(self, first: str, second: str, strings: bool = True):
        (self.first, self.second), self.strings = _vocabularies(first, second), strings
        self.size_a = np.array([len(b or b"") for b in self.first.bytes])
        self.size_b = np.array([len(b or b"") for b in self.second.bytes])
        self.names = {k: np.array([f"{i}{k}" for i in range(max(len(self.size_a), len(self.size_b)))], object) for k in ",|;"}
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.valid = np.zeros(0, bool)
        self.facts = np.zeros((0, 4), np.int64)  # first ids, second ids, groups, links
        self.starts = np.zeros(1, np.int64)  # of a chunk's links
        self.links = np.zeros(0, np.int64)
        self.groups: list[str] = []

    def chunks(self, text: str) -> list[str]:
        return _SPACE_BETWEEN.split(text) if self.second.local else [text]

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks that are not yet at hand."""
        a, b = self.first(chunks), self.second(chunks)
        raw = [(" " + c).encode() for c in chunks]
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        a, b = _flat(a), _flat(b)
        good = _spelt(a, n_a, self.first.bytes, self.size_a, raw) & _spelt(b, n_b, self.second.bytes, self.size_b, raw)
        if not good.all():
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        low = np.searchsorted(end_b, end_a - self.size_a[a], "right")
        each = np.searchsorted(end_b, end_a, "left") - low + 1
        links = np.repeat(a << 32, each) | b[_ranges(low, each)]
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        at_a, at_b = _starts(n_a), _starts(n_b)
        ends = np.append(0, end_a)[at_a[1:]]  # of the chunks
        n_groups = np.diff(np.searchsorted(cuts, ends, "right"), prepend=0)
        n_links = np.diff(np.append(0, np.cumsum(each))[at_a])

        base = len(self.number)
        self.number.update((c, base + k) for k, c in enumerate(chunks))
        self.valid = np.append(self.valid, good)
        self.facts = np.vstack([self.facts, np.stack([n_a, n_b, n_groups, n_links], 1)])
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(n_links))
        self.links = np.append(self.links, links)
        if self.strings:
            closes_a, closes_b = np.isin(end_a, cuts), np.isin(end_b, cuts)
            names = np.concatenate(
                [
                    np.where(closes_a, self.names["|"][a], self.names[","][a]),
                    np.where(closes_b, self.names[";"][b], self.names[","][b]),
                ]
            )
            side = np.concatenate([2 * np.searchsorted(cuts, end_a), 2 * np.searchsorted(cuts, end_b) + 1])
            names = names[np.argsort(side, kind="stable")].tolist()
            at = _starts(n_a + n_b).tolist()
            self.groups += ["".join(names[lo:hi]) for lo, hi in zip(at, at[1:])]

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chunks of the texts, and where each text starts among them; none for texts that do not align."""
        if len(self.number) > CACHE_CHUNKS:
            self.clear()
        cut = [self.chunks(t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.number)
        if new:
            self.learn(sorted(new))
        counts = np.array([len(c) for c in cut], np.int64)
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, counts.sum())
        if not self.valid[numbers].all():
            text = np.repeat(np.arange(len(texts)), counts)
            broken = np.isin(text, text[~self.valid[numbers]])
            numbers = numbers[~broken]
            counts = np.bincount(text[~broken], minlength=len(texts))
        return numbers, _starts(counts)


def _count(first: str, second: str):
    """(pair, number of its links) per task; one row of the pair -1 counts the bytes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, read = Aligner(first, second, strings=False), 0
        times = np.zeros(0, np.int64)

        def rows(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(pairs), 1 << 17):
                part = slice(lo, lo + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(pairs[part]), pa.array(n[part])], names=["pair", "n"])

        def added() -> Iterator[pa.RecordBatch]:
            pairs, place = np.unique(aligner.links, return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, place, np.repeat(times, np.diff(aligner.starts)[: len(times)]))
            yield from rows(pairs[n > 0], n[n > 0])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            sizes = [len(t or "") for t in texts]
            read += sum(sizes)
            for lo, hi in slices(sizes):
                if len(aligner.number) > CACHE_CHUNKS:
                    yield from added()
                    aligner.clear()
                    times = np.zeros(0, np.int64)
                numbers, _ = aligner.texts(texts[lo:hi])
                times = np.append(times, np.zeros(len(aligner.number) - len(times), np.int64))
                times += np.bincount(numbers, minlength=len(times))
        if len(times):
            yield from added()
        yield from rows(np.array([-1]), np.array([read]))

    return run


# A minimal perfect hash function in levels: a key that is alone in its bit of a level has the bit's rank as its slot,
# the others go on to the next level.


def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64((level + 1) << 56)) % np.uint64(size)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], bytes]:
    """Level sizes and bits of a function that gives distinct keys the numbers 0 to n - 1."""
    sizes, bits, rest = [], [], keys
    while len(rest):
        sizes.append(max(64, 2 * len(rest)))
        bit = _bit(rest, len(sizes) - 1, sizes[-1])
        alone = np.bincount(bit, minlength=sizes[-1]) == 1
        bits.append(alone)
        rest = rest[~alone[bit]]
    return sizes, np.packbits(np.concatenate([*bits, np.zeros(0, bool)])).tobytes()


def slots(keys: np.ndarray, sizes: list[int], bits: bytes) -> np.ndarray:
    """The number of each key, -1 for keys that no level holds; other unknown keys get some number."""
    flags = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    out, rest, at, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0, 0
    for level, size in enumerate(sizes):
        here = flags[at : at + size]
        rank = np.cumsum(here)
        bit = _bit(keys[rest], level, size)
        hit = here[bit]
        out[rest[hit]] = base + rank[bit[hit]] - 1
        at, base, rest = at + size, base + int(rank[-1]), rest[~hit]
    return out


def _checked_slots(keys: np.ndarray, sizes: list[int], bits: bytes, known: np.ndarray) -> np.ndarray:
    place = slots(keys, sizes, bits)
    if len(keys) and (place.min() < 0 or (known[place] != keys).any()):
        raise RuntimeError("a pair was not met by the first pass: the input changed between two reads")
    return place


def _shard(pair, shards: int):
    """The shard of a pair, for columns and for arrays."""
    if isinstance(pair, Column):
        first, second = F.shiftright(pair, 32), pair.bitwiseAND(F.lit(0xFFFFFFFF))
    else:
        first, second = pair >> 32, pair & 0xFFFFFFFF
    return (first * 7919 + second) % shards


_FUNCTION = "_shard bigint, _sizes array<int>, _bits binary, _keys binary"


def _functions(pairs: DataFrame) -> DataFrame:
    """A hash function for each shard of distinct pairs (_shard, pair), with the key of each slot."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(rows["pair"].to_numpy(np.int64))
        sizes, bits = perfect_hash(keys)
        known = np.empty_like(keys)
        known[slots(keys, sizes, bits)] = keys
        return pd.DataFrame({"_shard": [rows["_shard"].iloc[0]], "_sizes": [sizes], "_bits": [bits], "_keys": [known.tobytes()]})

    return pairs.groupBy("_shard").applyInPandas(build, _FUNCTION)


def _vectors(counted: DataFrame, functions: DataFrame, leaves: int) -> DataFrame:
    """Counts of each shard as one dense vector by slot: vectors of leaves first, then their sums up a tree."""

    def leaf(key: tuple, rows: pd.DataFrame, function: pd.DataFrame) -> pd.DataFrame:
        f = function.iloc[0]
        known = np.frombuffer(f["_keys"], np.int64)
        counts = np.zeros(len(known), np.int64)
        np.add.at(counts, _checked_slots(rows["pair"].to_numpy(np.int64), f["_sizes"], f["_bits"], known), rows["n"].to_numpy(np.int64))
        return pd.DataFrame({"_shard": [key[0]], "_leaf": [key[1]], "_counts": [counts.tobytes()]})

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(v, np.int64) for v in rows["_counts"])
        return pd.DataFrame({"_shard": [key[0]], "_leaf": [key[1]], "_counts": [counts.tobytes()]})

    schema = "_shard bigint, _leaf bigint, _counts binary"
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    dealt = counted.withColumn("_leaf", F.pmod(part, F.lit(leaves)))
    at_leaves = functions.withColumn("_leaf", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(leaves - 1).cast("bigint"))))
    there = dealt.groupBy("_shard", "_leaf").cogroup(at_leaves.groupBy("_shard", "_leaf"))
    vectors = there.applyInPandas(lambda k, rows, f: leaf(k, rows, f) if len(rows) else pd.DataFrame({"_shard": [], "_leaf": [], "_counts": []}), schema)
    while leaves > 1:
        leaves = math.ceil(leaves / FAN)
        up = vectors.withColumn("_leaf", F.floor(F.col("_leaf") / FAN))
        vectors = up.groupBy("_shard", "_leaf").applyInPandas(total, schema)
    return vectors.select("_shard", "_counts")


def _tables(functions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per shard: hash function, keys, counts and whether a pair is the most frequent one of its second id."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                keys, counts = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                columns = [np.full(len(keys), shard), np.arange(len(keys)), keys & 0xFFFFFFFF, counts]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_shard", "_slot", "second", "n"])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        best = rows.sort_values("_slot")["_best"].to_numpy(bool)
        return pd.DataFrame({"_shard": [rows["_shard"].iloc[0]], "_best": [best.tobytes()]})

    both = functions.join(vectors, "_shard")
    entries = both.select("_shard", "_keys", "_counts").mapInArrow(unpack, "_shard bigint, _slot bigint, second bigint, n bigint")
    # an id of the second vocabulary meets at most the whole first vocabulary
    most = F.max("n").over(W.partitionBy("second"))
    best = entries.withColumn("_best", F.col("n") == most).groupBy("_shard").applyInPandas(pack, "_shard bigint, _best binary")
    return both.join(best, "_shard")


def _incidence(first: str, second: str, shards: int, nodes: int):
    """Per slice of texts and shard: which text has which pair how often; what is known of the texts goes with one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(first, second)
        for batch in batches:
            texts, ids, rows = batch.column(1).to_pylist(), batch.column(0), batch.column(2).to_numpy()
            for lo, hi in slices([len(t or "") for t in texts]):
                numbers, starts = aligner.texts(texts[lo:hi])
                text = np.repeat(np.arange(hi - lo), np.diff(starts))
                facts = np.diff(np.vstack([np.zeros((1, 4), np.int64), np.cumsum(aligner.facts[numbers], 0)])[starts], axis=0)
                listed = list(map(aligner.groups.__getitem__, numbers.tolist()))
                hashed = []
                for s, e in zip(starts.tolist(), starts[1:].tolist()):
                    hashed.append(hashlib.sha256("".join(listed[s:e])[:-1].encode()).hexdigest() if e > s else "")
                # equal chunks of a text first, then equal links
                both, times = np.unique(text * len(aligner.number) + numbers, return_counts=True)
                owner, number = np.divmod(both, max(1, len(aligner.number)))
                each = np.diff(aligner.starts)[number]
                pair = aligner.links[_ranges(aligner.starts[number], each)]
                owner, times = np.repeat(owner, each), np.repeat(times, each)
                shard = _shard(pair, shards)
                order = np.lexsort((pair, owner, shard))
                shard, owner, pair, times = shard[order], owner[order], pair[order], times[order]
                new = np.flatnonzero(np.append(True, (np.diff(pair) != 0) | (np.diff(owner) != 0)))[: len(pair)]
                times = np.add.reduceat(times, new) if len(new) else times
                shard, owner, pair = shard[new], owner[new], pair[new]

                node = int(rows[lo]) * 2654435761 % (1 << 32) % nodes
                home = int(rows[lo]) % shards
                present = np.union1d(shard, [home]).astype(np.int64)
                bounds = np.stack([np.searchsorted(shard, present, "left"), np.searchsorted(shard, present, "right")], 1).tolist()
                heads = pa.StructArray.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(rows[lo:hi]),
                        *(pa.array(np.ascontiguousarray(facts[:, k])) for k in range(4)),
                        pa.array(hashed, pa.string()),
                    ],
                    names=["output_id", "_row", "n_first", "n_second", "n_groups", "n_links", "groups_sha256"],
                )
                empty = heads.slice(0, 0)
                columns = {
                    "_shard": pa.array(present),
                    "_node": pa.array(np.full(len(present), node)),
                    "_rows": pa.array([np.ascontiguousarray(rows[lo:hi], np.int64).tobytes()] * len(present), pa.binary()),
                    "_owner": pa.array([owner[s:e].astype(np.uint32).tobytes() for s, e in bounds], pa.binary()),
                    "_pairs": pa.array([pair[s:e].tobytes() for s, e in bounds], pa.binary()),
                    "_times": pa.array([times[s:e].astype(np.int64).tobytes() for s, e in bounds], pa.binary()),
                    "_heads": pa.concat_arrays(
                        [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (heads if p == home else empty for p in present)]
                    ),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


_FACTS = ("n_first", "n_second", "n_groups", "n_links", "groups_sha256")


def _look_up():
    """Counts of the links of a shard, summed up by text; what is known of the texts passes through."""

    def run(links: pa.Table, table: pa.Table) -> pa.Table:
        heads = links.column("_heads").combine_chunks().flatten()
        fixed = {n: heads.field(n) for n in ("output_id", "_row", *_FACTS)}
        rows, best, total = [], [], []
        if table.num_rows:
            f = table.slice(0, 1).to_pylist()[0]
            known, counts = np.frombuffer(f["_keys"], np.int64), np.frombuffer(f["_counts"], np.int64)
            tops = np.frombuffer(f["_best"], bool)
            for k in range(links.num_rows):
                at, owner, pair, times = (
                    np.frombuffer(links.column(c)[k].as_py(), t) for c, t in zip(("_rows", "_owner", "_pairs", "_times"), (np.int64, np.uint32, np.int64, np.int64))
                )
                if not len(pair):
                    continue
                place = _checked_slots(pair, f["_sizes"], f["_bits"], known)
                new = np.flatnonzero(np.append(True, np.diff(owner.astype(np.int64)) != 0))
                rows.append(at[owner[new]])
                best.append(np.add.reduceat(np.where(tops[place], times, 0), new))
                total.append(np.add.reduceat(times * counts[place], new))
        n_heads, n_sums = len(heads), sum(map(len, rows))

        def sums(parts: list[np.ndarray]) -> pa.Array:
            return pa.array(np.concatenate([np.zeros(n_heads, np.int64), *parts]).astype(np.int64))

        columns = {n: pa.concat_arrays([a, pa.nulls(n_sums, a.type)]) for n, a in fixed.items()}
        columns["_row"] = pa.concat_arrays([fixed["_row"], pa.array(np.concatenate([np.zeros(0, np.int64), *rows]))])
        return pa.table(columns | {"n_best": sums(best), "count_sum": sums(total)})

    return run


def align(
    outputs: DataFrame,
    first: str,
    second: str,
    shard_pairs: int = SHARD_PAIRS,
    leaf_rows: int = LEAF_ROWS,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Align the tokens of two vocabularies over the ``content`` of outputs (output_id, content).

    ``first`` is a byte-level vocabulary file, which encodes a space and the content; ``second`` a piece model, which
    puts the space before by itself. Offsets where tokens of both end cut a content into groups; two tokens whose
    byte ranges overlap are linked, and the count of an id pair is the number of its links in all contents.

    A first pass counts the pairs of each task. The distinct pairs are dealt into shards, each with a minimal perfect
    hash function and the key of every slot. Counts become dense vectors by slot, which are added up in a tree, 16 at
    a time. A second pass aligns the contents again and sends, per slice of contents and shard, which content has
    which pair how often; there slots are looked up, their keys verified and the counts read.

    Returns, per row of ``outputs``: output_id, n_first, n_second, n_groups, n_links, n_best (links whose count is the
    highest of their second id, ties included), count_sum (over the links) and groups_sha256 (of the ids by group,
    ``a1,a2|b1;a3|b2``). Null and empty contents, and those that one of the two cannot spell back byte by byte,
    have no tokens: zeros, and '' for the hash; they count nowhere. Repeated rows give and count a row each, a null id
    stays null, other columns are ignored, an empty table gives an empty one.

    No task holds more than a shard (about ``shard_pairs`` pairs), ``FAN`` vectors of one, or the links of about
    ``group_bytes`` of content (a longer content is not divided); no pair passes through the driver.
    """
    texts = outputs.select("output_id", F.col("content").cast("string").alias("content"))
    counted = materialize(texts.select("content").mapInArrow(_count(first, second), "pair bigint, n bigint"), "pairs")
    met = counted.filter("pair >= 0")
    size = counted.agg(
        F.approx_count_distinct(F.when(F.col("pair") >= 0, F.col("pair"))).alias("pairs"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(F.col("pair") < 0, F.col("n"))).alias("bytes"),
    ).head()
    shards = max(1, math.ceil(size["pairs"] / shard_pairs))
    leaves = max(1, math.ceil(size["rows"] / shards / leaf_rows))
    nodes = max(1, math.ceil((size["bytes"] or 0) / group_bytes / shards))

    met = met.withColumn("_shard", _shard(F.col("pair"), shards))
    functions = materialize(_functions(met.select("_shard", "pair").distinct()), "functions")
    tables = materialize(_tables(functions, _vectors(met, functions, leaves)), "tables")

    id_type = texts.schema["output_id"].dataType
    facts = "n_first bigint, n_second bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    links = texts.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(
        _incidence(first, second, shards, nodes),
        "_shard bigint, _node bigint, _rows binary, _owner binary, _pairs binary, _times binary, "
        f"_heads array<struct<output_id:{id_type.simpleString()},_row:bigint,{facts.replace(' bigint', ':bigint').replace(' string', ':string').replace(', ', ',')}>>",
    )
    at_nodes = tables.withColumn("_node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nodes - 1).cast("bigint"))))
    parts = (
        links.groupBy("_shard", "_node")
        .cogroup(at_nodes.groupBy("_shard", "_node"))
        .applyInArrow(_look_up(), f"output_id {id_type.simpleString()}, _row bigint, {facts}, n_best bigint, count_sum bigint")
    )
    return (
        parts.groupBy("_row")
        .agg(
            F.max("output_id").alias("output_id"),
            *(F.max(c).alias(c) for c in _FACTS[:-1]),
            F.sum("n_best").alias("n_best"),
            F.sum("count_sum").alias("count_sum"),
            F.max("groups_sha256").alias("groups_sha256"),
        )
        .drop("_row")
    )
