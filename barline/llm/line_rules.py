"""Quality rules, lines first: drop navigation and boilerplate lines, then texts that lose too much."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.text import WORD, utf8, window_hashes, word_hashes

#: a text is rejected if more than this percentage of its words stands in lines that fail a rule
MAX_LOST = 40

REPEAT_WORDS = 5

SYMBOLS = "#*$%&|<>"

#: an end of a sentence
SENTENCE_END = r"""[.!?…。！？]["')\]»”]*([\x20\x09-\x0D]|$)"""
#: a word that only separates links
SEPARATOR = r"(^|[\x20\x09-\x0D])[|>»/·•]+([\x20\x09-\x0D]|$)"
#: notices that pages repeat
BOILERPLATE = (
    r"(?i)all rights reserved|licensed under the|terms of (use|service)|privacy policy|use of cookies|accept cookies"
    r"|copyright (\(c\)|©)|click here|sign up for our|subscribe to our|enable javascript|lorem ipsum"
)

RULES = ("punctuation", "symbols", "navigation", "shouting", "boilerplate")

_WORD = re.compile(WORD)
_END, _SEPARATOR, _NOTICE = re.compile(SENTENCE_END), re.compile(SEPARATOR), re.compile(BOILERPLATE)
_NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


def failed_rule(line: str, raw: bytes, n: int) -> int:
    """Index of the first rule that a line of n words fails, -1 if it passes all.

    punctuation: no sentence ends in the line. symbols: half as many symbols (doubled exclamation marks
    count as one) as words, or more. navigation: two words or more that are only separators. shouting: of
    at least 12 ASCII letters more than half are capitals. boilerplate: a notice that pages repeat.
    """
    if not _END.search(line):
        return 0
    if 2 * (len(raw) - len(raw.translate(None, SYMBOLS.encode())) + raw.count(b"!!")) >= n:
        return 1
    # neighbours share the space between them, so the separators are looked up one by one
    at, found = 0, 0
    while found < 2 and (m := _SEPARATOR.search(line, at)):
        found, at = found + 1, max(m.end() - 1, m.start() + 1)
    if found >= 2:
        return 2
    letters = len(raw.translate(None, _NOT_LETTER))
    if letters >= 12 and 2 * len(raw.translate(None, _NOT_UPPER)) > letters:
        return 3
    return 4 if _NOTICE.search(line) else -1


def _repeated(words: list[bytes]) -> int:
    """Words that stand in a run of five words found twice or more."""
    runs = window_hashes(word_hashes(words), REPEAT_WORDS) if len(words) > REPEAT_WORDS else ()
    if not len(runs):
        return 0
    _, back, counts = np.unique(runs, return_inverse=True, return_counts=True)
    again = counts[back] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + REPEAT_WORDS, -1)
    return int((np.cumsum(edges) > 0).sum())


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"lost_{r}" for r in RULES)]


def clean_lines(edges: DataFrame, max_lost: int = MAX_LOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """Judge the rationale of every edge line by line.

    ``edges`` needs edge_id and rationale; the columns named in ``carry`` go with the rows (their names must
    not be among those added), others are not read. One row for each row: edge_id; n_words,
    word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text; lost_<rule>, the words in lines
    that fail this rule first; base_failed (under ten words, or over a fifth of them in repeated runs of
    five); kept (not base_failed and at most ``max_lost`` % of the words lost); cleaned, the text without the
    failing lines. Lines are cut at \\n; a line without words is neither judged nor removed. A null rationale
    has no words, fails the base rules and stays null. Repeated rows are judged each, ids may be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(1))
            rows, cleaned = [], []
            for text in texts:
                if text is None:
                    rows.append([0] * len(_COLUMNS))
                    cleaned.append(None)
                    continue
                words = text.split()
                lost, kept, seen, again = [0] * len(RULES), [], set(), 0
                for raw in text.split(b"\n"):
                    n = len(raw.split())
                    if n:
                        again += raw in seen
                        seen.add(raw)
                        rule = failed_rule(raw.decode(), raw, n)
                        if rule >= 0:
                            lost[rule] += n
                            continue
                    kept.append(raw)
                symbols = len(text) - len(text.translate(None, SYMBOLS.encode()))
                chars = len(b"".join(words).decode())
                rows.append([len(words), chars, symbols, again, _repeated(words), *lost])
                cleaned.append(b"\n".join(kept) if any(lost) else text)
            table = np.array(rows, np.int64).reshape(-1, len(_COLUMNS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(table[:, k]) for k in range(table.shape[1])), pa.array(cleaned, pa.binary()).cast(pa.string()), *batch.columns[2:]],
                names=["edge_id", *_COLUMNS, "cleaned", *carry],
            )

    narrow = edges.select("edge_id", F.col("rationale").cast("string").alias("rationale"), *carry)
    added = [*(T.StructField(c, T.LongType()) for c in _COLUMNS), T.StructField("cleaned", T.StringType())]
    carried = [T.StructField(c, narrow.schema[c].dataType) for c in carry]
    schema = T.StructType([T.StructField("edge_id", narrow.schema["edge_id"].dataType), *added, *carried])
    counted = narrow.mapInArrow(run, schema)
    lost = sum((F.col(f"lost_{r}") for r in RULES), F.lit(0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select(
        *(c for c in counted.columns if c != "cleaned" and c not in carry),
        failed.alias("base_failed"),
        (~failed & (100 * lost <= max_lost * F.col("n_words"))).alias("kept"),
        "cleaned",
        *carry,
    )
