"""Token sequences of a fixed length, filled by sum-of-squares packing."""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.text import slices
from barline.session import materialize

#: pieces that one task packs together; more give fuller sequences, fewer give more tasks
GROUP_PIECES = 1 << 12

#: pre-tokens whose ids a Python worker keeps at hand
CACHE_WORDS = 300_000

_PIECES = "output_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


def default_vocabulary() -> str:
    """Path of the public vocabulary file with word ends, which is installed beside its package."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of texts, computed once per distinct pre-token.

    No token of the vocabulary spans white space, so the ids of a text are the ids of its chunks in order.
    Chunks of ASCII and Latin-1 letters, which normalisation leaves as they are but for case, are cut by the
    tokenizer's own pre-token pattern and given to its model; all others go through the whole tokenizer.
    The pattern is applied to a whole list of texts by the kinds of their characters.
    """

    # kinds of characters; OTHER are those that need the whole tokenizer
    SPACE, LETTER, DIGIT, MARK, OTHER = range(5)

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.model = self.whole.model
        # byte-level models spell the two UTF-8 bytes of a Latin-1 letter as two characters
        self.spell = {c: "".join(_byte_letter(b) for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.kinds = np.full(0x110000, self.OTHER, np.uint8)
        self.kinds[0x21:0x7F] = self.MARK
        self.kinds[ord("0") : ord("9") + 1] = self.DIGIT
        for first, last in ("AZ", "az", "ÀÖ", "Øö", "øÿ"):
            self.kinds[ord(first) : ord(last) + 1] = self.LETTER
        # str.isspace also holds for four controls that are no white space to the tokenizer
        self.kinds[[c for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]] = self.SPACE
        self.lower = np.arange(256, dtype=np.uint8)
        for first, last in ("AZ", "ÀÖ", "ØÞ"):
            self.lower[ord(first) : ord(last) + 1] += 32
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes | str, int] = {}  # of pre-tokens in Latin-1, and of chunks for the whole tokenizer
        self.starts = np.zeros(1, np.int64)  # of a number's ids
        self.ids = np.zeros(0, np.uint32)

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        """The kind of each code point; a chunk that needs the whole tokenizer is OTHER throughout."""
        kinds = self.kinds[points]
        kinds[:-1][(points[:-1] == ord("<")) & (points[1:] == ord("|"))] = self.OTHER
        if (kinds == self.OTHER).any():
            edges = np.flatnonzero(np.diff(kinds != self.SPACE, prepend=False, append=False))
            begins, ends = edges[::2], edges[1::2]
            whole = np.maximum.reduceat(kinds, begins) == self.OTHER
            depth = np.zeros(len(kinds) + 1, np.int8)
            depth[begins[whole]] = 1
            depth[ends[whole]] = -1
            kinds[np.cumsum(depth[:-1], dtype=np.int8) > 0] = self.OTHER
        return kinds

    def _cuts(self, kinds: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Where runs of white space, pre-tokens and chunks of OTHER begin."""
        begins = np.append(True, (kinds[1:] != kinds[:-1]) | (kinds[1:] == self.DIGIT))
        # 's 't 'm 'd 're 've 'll, where the apostrophe begins a run
        at = np.flatnonzero(begins & (low == ord("'")) & (kinds == self.MARK))
        after = np.append(low, np.zeros(2, np.uint8))
        one, two = after[at + 1], after[at + 2]
        e, r, v, ll = (ord(c) for c in "ervl")
        short = np.isin(one, list(b"stmd"))
        long = ((two == e) & ((one == r) | (one == v))) | ((one == ll) & (two == ll))
        begins = np.append(begins, [True, True, True])
        begins[at[short | long] + 1] = False
        begins[at[short] + 2] = True
        begins[at[long] + 3] = True
        return np.flatnonzero(begins[: len(kinds)])

    def _numbers(self, pieces: list[bytes | str]) -> np.ndarray:
        """The numbers of pre-tokens (bytes) or chunks for the whole tokenizer; those not yet at hand are encoded."""
        found = np.fromiter(map(self.numbers.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = list(dict.fromkeys([pieces[i] for i in missing]))
            made = [self._encode(p) for p in new]
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new))))
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
            self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(made), np.uint32, sizes.sum()))
            found[missing] = [self.numbers[pieces[i]] for i in missing]
        return found

    def _encode(self, piece: bytes | str) -> list[int]:
        if isinstance(piece, str):
            return self.whole.encode(piece, add_special_tokens=False).ids
        spelt = piece.decode("ascii") if piece.isascii() else piece.decode("latin-1").translate(self.spell)
        return [t.id for t in self.model.tokenize(spelt)]

    def _plain_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has; the pattern is applied to all at once."""
        if len(self.numbers) > CACHE_WORDS:
            self.clear()
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kinds, low = self._kinds(points), self.lower[np.minimum(points, 0xFF)]
        cuts = self._cuts(kinds, low)
        sizes, kind = np.diff(cuts, append=len(points)), kinds[cuts]
        plain, other = (kind != self.SPACE) & (kind != self.OTHER), kind == self.OTHER
        ends = np.cumsum(np.append(0, sizes[plain])).astype(np.int32)
        letters = low[(kinds != self.SPACE) & (kinds != self.OTHER)]
        cut = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        cut = cut.dictionary_encode()
        chunks = [joined[a : a + n] for a, n in zip(cuts[other].tolist(), sizes[other].tolist())]
        found = np.empty(len(cuts), np.int64)
        found[plain] = self._numbers(cut.dictionary.to_numpy(zero_copy_only=False).tolist())[cut.indices.to_numpy()]
        if chunks:
            found[other] = self._numbers(chunks)
        found, cuts = found[plain | other], cuts[plain | other]
        first = self.starts[found]
        sizes = self.starts[found + 1] - first
        ends = np.append(0, np.cumsum(sizes))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(first - ends[:-1], sizes)]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        return ids, np.diff(ends[np.searchsorted(cuts, np.cumsum(lengths + 1))], prepend=0)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each begins (and the last ends)."""
        ids, sizes = self._plain_ids(texts)
        return ids, np.append(0, np.cumsum(sizes))

    def __call__(self, text: str) -> np.ndarray:
        return self.texts([text])[0]


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str) -> WordTokenizer:
    """One tokenizer for all tasks of a Python worker, with the pre-tokens it has met."""
    return WordTokenizer(vocabulary)


def _byte_letter(b: int) -> str:
    """The character that byte-level models write for a byte; only those of UTF-8 sequences are needed."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return chr(b) if b in shown else chr(0x100 + [x for x in range(256) if x not in shown].index(b))


def token_pieces(
    outputs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "output_id"
) -> DataFrame:
    """The token ids of each content and an end id, cut into pieces of at most ``capacity``.

    One row per piece: output_id, piece (from 0), start, length and the CRC-32 of the ids as little-endian
    unsigned 32-bit numbers. Null contents are empty and give the end id only.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices([len(t or "") for t in texts]):
                row, piece, start, length, crc = [], [], [], [], []
                found, begins = tokenizer.texts([t or "" for t in texts[lo:hi]])
                # an end id behind each text
                found = np.insert(found, begins[1:], np.uint32(end_id)).astype("<u4")
                begins = (begins + np.arange(len(begins))).tolist()
                for i in range(lo, hi):
                    ids = found[begins[i - lo] : begins[i - lo + 1]]
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                columns = [pa.array(piece, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int32())), *columns],
                    names=["output_id", "piece", "start", "length", "ids_crc32"],
                )

    narrow = outputs.select(F.col(id_col).alias("output_id"), F.col("content").cast("string").alias("content"))
    return narrow.mapInArrow(cut, _PIECES.format(id=narrow.schema["output_id"].dataType.simpleString()))


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and gap left in the bin at the end, for items placed one by one in the order given.

    An item goes into the open bin that leaves the sum over gaps of (open bins with this gap) squared smallest,
    on a tie into the fullest; full bins are not counted. A new bin is opened where the item fits in none: left
    free to open one whenever that sum is smaller, the rule needs four in a hundred bins more.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    left: list[int] = []
    never = np.iinfo(np.int64).max
    for i, size in enumerate(sizes.tolist()):
        here = count[size:]
        # of N(g)^2 + N(g - size)^2 the change, where bins of gap 0 do not count
        change = 2 * (count[: capacity + 1 - size] - here) + 2
        change[0] = 1 - 2 * here[0]
        change[here == 0] = never
        best = int(change.argmin())
        gap = size + best
        if here[best]:
            number = stacks[gap].pop()
            count[gap] -= 1
        else:
            number, gap = len(left), capacity
            left.append(capacity)
        bins[i], offsets[i], left[number] = number, capacity - gap, gap - size
        if gap > size:
            stacks[gap - size].append(number)
            count[gap - size] += 1
    return bins, offsets, np.array(left, np.int64)[bins]


def _pack_group(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        bins, rows["offset"], rows["_gap"] = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = rows["_group"] * (1 << 32) + bins
        return rows

    return pack


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES, loose: int = 32) -> DataFrame:
    """Place pieces (output_id, piece, start, length, ids_crc32) into sequences of ``capacity`` ids.

    Adds sequence_id and offset. A piece of full length is a sequence of its own. The others are dealt into
    groups of about ``group_pieces``; a group is packed longest first by ``sum_of_squares``. Sequences that keep a gap of more than
    ``capacity / loose`` are opened again, and their pieces packed once more across groups. A piece longer than ``capacity`` is an error
    of the caller (``token_pieces`` makes none). Repeated rows are packed each; an empty table gives an empty one.
    """
    spark = pieces.sparkSession
    wanted = [*pieces.columns, "sequence_id", "offset"]
    # read back from files, a row keeps its number when a task is repeated
    rows = materialize(pieces, "pieces").withColumn("_row", F.monotonically_increasing_id())
    whole = rows.filter(F.col("length") >= capacity).select(
        *pieces.columns, (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    part = rows.filter(F.col("length") < capacity)

    def dealt(df: DataFrame, first: int) -> DataFrame:
        groups = max(1, math.ceil(df.count() / group_pieces))
        group = F.pmod(F.xxhash64("_row"), F.lit(groups)) + F.lit(first)
        grouped = df.withColumn("_group", group.cast("bigint"))
        schema = T.StructType(
            [*grouped.schema.fields, *(T.StructField(c, T.LongType()) for c in ("offset", "_gap", "sequence_id"))]
        )
        return grouped.groupBy("_group").applyInPandas(_pack_group(capacity), schema)

    first = materialize(dealt(part, 0), "packed")
    tight = F.col("_gap") * loose <= capacity
    again = dealt(first.filter(~tight).drop("_group", "offset", "_gap", "sequence_id"), 1 << 29)
    return whole.unionByName(first.filter(tight).select(*wanted)).unionByName(again.select(*wanted))
