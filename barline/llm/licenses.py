"""Licence notices in texts, found by an exact set-similarity join with prefix, length and positional filters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.text import slices, utf8

#: everything but ASCII letters, digits and what lies beyond ASCII becomes a space, capitals become small
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: templates are held by every task; more than this many words of theirs are refused
MAX_TEMPLATE_WORDS = 1 << 16


@dataclass(frozen=True)
class Template:
    """A notice and its label.

    A ``phrase`` must stand as it is, word after word. Other templates are word sets: a block of text meets one if
    it holds at least ``percent`` of its distinct words, in any order.
    """

    label: str
    text: str
    phrase: bool = False
    percent: int = 90

    @property
    def words(self) -> list[str]:
        return [w.decode() for w in self.text.encode().translate(_FOLD).split()]


# Phrases with their labels, and wordings of public licences
TEMPLATES = (
    Template("gpl", "gnu general public license", phrase=True),
    Template("apache", "apache license", phrase=True),
    Template("cc-by", "cc by", phrase=True),
    Template("mit", "mit license", phrase=True),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template("gpl", "free software you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    Template("apache-2", "licensed under the Apache License, Version 2.0"),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("cc-by-nc", "licensed under CC BY-NC"),
    Template("cc-by-sa", "licensed under CC BY-SA"),
    Template("cc-by", "licensed under a Creative Commons Attribution International License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("public-domain", "This is free and unencumbered software released into the public domain"),
)


def _checked(templates: Sequence[Template], block_words: int, stride: int) -> list[Template]:
    templates = [t for t in templates if t.words]
    longest = block_words - stride + 1
    if not 0 < stride <= block_words or any(len(t.words) > longest for t in templates):
        raise ValueError(f"a template of more than {longest} words does not lie whole in any block")
    if not all(0 < t.percent <= 100 for t in templates) or sum(len(t.words) for t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError("shares are 1 to 100 percent, and templates have a bounded number of words")
    return templates


def _needed(t: Template) -> int:
    n = len(set(t.words))
    return n if t.phrase else (t.percent * n + 99) // 100


def word_counts(texts: DataFrame, words: Sequence[str]) -> dict[str, int]:
    """How often each of ``words`` stands in the one text column; the rows that are collected are theirs alone."""
    number = {w.encode(): k for k, w in enumerate(words)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number), np.int64)
        for batch in batches:
            for text in utf8(batch.column(0)):
                codes = np.fromiter(map(number.get, (text or b"").translate(_FOLD).split(), repeat(-1)), np.int64)
                total += np.bincount(codes[codes >= 0], minlength=len(number))
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(total[kept])], names=["word", "n"])

    found = texts.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    known = {r["word"]: r["n"] for r in found.collect()}
    return {w: known.get(k, 0) for k, w in enumerate(words)}


def _encoder(rank: dict[bytes, int], in_prefix: np.ndarray, block_words: int, stride: int):
    """One row per text with its number of words, and one per block that holds a word of some template's prefix.

    ``codes`` are the ranks of a block's words in order, -1 for words of no template; ``ranks`` are the distinct
    ones, rarest first.
    """

    def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = utf8(batch.column(1)), batch.column(2).to_numpy()
            for lo, hi in slices([len(t or b"") for t in texts]):
                words = [(texts[i] or b"").translate(_FOLD).split() for i in range(lo, hi)]
                counts = np.array([len(w) for w in words], np.int64)
                none = pa.nulls(hi - lo, pa.list_(pa.int32()))
                ids = batch.column(0).slice(lo, hi - lo)
                flags = pa.array(np.zeros(hi - lo, bool))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(rows[lo:hi]), pa.array(counts), pa.nulls(hi - lo, pa.int64()), flags, none, none],
                    names=["output_id", "_row", "n_words", "_start", "_last", "_codes", "_ranks"],
                )
                codes = [np.fromiter(map(rank.get, w, repeat(-1)), np.int32, len(w)) for w in words]
                found = []  # text, block, codes
                for i, code in enumerate(codes):
                    at = np.flatnonzero(code >= 0)
                    at = at[in_prefix[code[at]]] // stride
                    last = max(0, -(-(len(code) - block_words) // stride))
                    reach = range((block_words - 1) // stride + 1)  # blocks that hold a word, from its own stride back
                    hit = np.unique(np.concatenate([at - k for k in reach])) if len(at) else at
                    found += [(i, b, b == last, code[b * stride :][:block_words]) for b in hit.tolist() if 0 <= b <= last]
                if not found:
                    continue
                distinct = [np.unique(c[c >= 0]) for _, _, _, c in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(len(found), ids.type),
                        pa.array([rows[lo + i] for i, *_ in found], pa.int64()),
                        pa.nulls(len(found), pa.int64()),
                        pa.array([b * stride for _, b, _, _ in found], pa.int64()),
                        pa.array([bool(x) for _, _, x, _ in found]),
                        lists(np.concatenate([c for *_, c in found]), np.cumsum([len(c) for *_, c in found])),
                        lists(np.concatenate(distinct), np.cumsum([len(d) for d in distinct])),
                    ],
                    names=["output_id", "_row", "n_words", "_start", "_last", "_codes", "_ranks"],
                )

    return run


def scan(
    outputs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    block_words: int = 64,
    stride: int = 32,
) -> DataFrame:
    """Licences that the ``content`` of each output names, one row per row of ``outputs`` (output_id, content).

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. A block is a run of
    ``block_words`` words; one starts every ``stride`` words, the last ends with the text. Every block that holds
    enough of a template's distinct words is found: words are ordered by how often they stand in all contents,
    rarest first; a block and a template can only meet if they share a word of their prefixes, if the block has
    words enough (length), and if enough words are left on both sides from the first shared word on (position).
    Pairs that pass are compared in full. Phrases are then looked up word by word in the blocks found.

    Returns output_id, n_words, n_base (places of phrases), first_word and last_word (their smallest and largest
    start, null without one), base_labels and labels (of phrases; of all templates; sorted, comma-joined) and
    score, the largest share of a template's distinct words that one block holds (0 where none meets its threshold).

    Null and empty contents have no words and no label. Repeated rows give a row each, a null id stays null; other
    columns are ignored. An empty table gives an empty one. Templates are a list in memory (at most 2^16 words);
    nothing else is held by all tasks, and rows meet again only by row.
    """
    spark = outputs.sparkSession
    templates = _checked(templates, block_words, stride)
    texts = outputs.select("output_id", F.col("content").cast("string").alias("content"))
    vocabulary = sorted({w for t in templates for w in t.words})
    counts = word_counts(texts.select("content"), vocabulary)
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts[w], w)))}

    index, in_prefix = [], np.zeros(len(rank) + 1, bool)
    for number, t in enumerate(templates):
        members = sorted({rank[w] for w in t.words})
        for j, r in enumerate(members[: len(members) - _needed(t) + 1]):
            index.append((r, number, j, _needed(t), members, [rank[w] for w in t.words] if t.phrase else None, t.label))
            in_prefix[r] = True
    least = min((_needed(t) for t in templates), default=1)
    prefixes = spark.createDataFrame(
        index, "_rank int, _template int, _j int, _need int, _members array<int>, _phrase array<int>, _label string"
    )

    kind = texts.schema["output_id"].dataType.simpleString()
    blocks = texts.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(
        _encoder({w.encode(): r for w, r in rank.items()}, in_prefix, block_words, stride),
        f"output_id {kind}, _row bigint, n_words bigint, _start bigint, _last boolean, _codes array<int>, _ranks array<int>",
    )
    size = F.size("_ranks")
    probes = blocks.select("*", F.posexplode_outer(F.slice("_ranks", 1, F.greatest(F.lit(0), size - least + 1))).alias("_i", "_rank"))
    pairs = probes.filter("_start IS NULL OR _rank IS NOT NULL").join(prefixes, "_rank", "left")
    length = size >= F.col("_need")
    position = F.least(size - F.col("_i"), F.size("_members") - F.col("_j")) >= F.col("_need")
    pairs = pairs.filter(F.col("_start").isNull() | (length & position))
    common = F.array_intersect("_ranks", "_members")
    # a pair that shares several words of its prefixes counts once, at the first
    met = (F.size(common) >= F.col("_need")) & (F.get(common, F.lit(0)) == F.col("_rank"))
    pairs = pairs.withColumn("_met", F.coalesce(F.col("_start").isNotNull() & met, F.lit(False)))

    is_phrase = F.col("_phrase").isNotNull()
    m = F.size("_phrase")
    # a place belongs to the one block that it starts in the first stride of
    end = F.when(F.col("_last"), F.size("_codes") - m).otherwise(F.least(F.lit(stride - 1), F.size("_codes") - m))
    starts = F.when(
        F.col("_met") & is_phrase & (end >= 0),
        F.filter(F.sequence(F.lit(0), F.greatest(end, F.lit(0))), lambda s: F.slice("_codes", s + 1, m) == F.col("_phrase")),
    )
    pairs = pairs.withColumn("_starts", starts)

    def start(of: Column) -> Column:
        return (F.col("_start") + of).cast("bigint")

    placed = F.coalesce(F.size("_starts") > 0, F.lit(False))
    hit = F.when(is_phrase, placed).otherwise(F.col("_met"))
    share = F.size(common) / F.size("_members")

    def labels(which: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("_label")))), ",")

    return (
        pairs.groupBy("_row")
        .agg(
            F.max("output_id").alias("output_id"),
            F.max("n_words").alias("n_words"),
            F.sum(F.when(placed, F.size("_starts")).otherwise(0)).cast("bigint").alias("n_base"),
            F.min(start(F.array_min("_starts"))).alias("first_word"),
            F.max(start(F.array_max("_starts"))).alias("last_word"),
            labels(is_phrase & placed).alias("base_labels"),
            labels(hit).alias("labels"),
            F.max(F.when(hit, share).otherwise(0.0)).alias("score"),
        )
        .drop("_row")
    )
