"""Operator 5: language identification by prediction by partial matching.

Each language has a byte-context tree of orders 0 to ``order``. A byte seen after its context at
some order has probability n / (N + q) there (N bytes seen after the context, q of them distinct),
and any other byte escapes with q / (N + q) to the context that is one byte shorter, at last to a
uniform byte. The statistics are frozen after training, so the code length of a text is a sum of
table entries; the language with the shortest code wins.

Training reads a bounded sample: about ``sample_bytes`` of distinct texts a language, those with the smallest
hashes, and of each language at least its first text by hash (of a text longer than ``sample_bytes`` as many
of its first characters, as far as training goes). The hash is compared with a bound of 63 bits, so a language
may be of any size. Grams are counted in Spark. The trees hold at most ``MAX_CELLS`` cells (grams times languages):
with very many languages the most frequent grams stay. They are sent to every task once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import field, staged
from .text import CHUNK_BYTES, U, slices, utf8

START = 0x0A
MAX_CELLS = 1 << 25
MOST = (1 << 63) - 1
CELLS_AT_ONCE = 1 << 21         # positions times languages that are scored at a time
LETTER = re.compile(r"[^\W\d_]")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def padded(data: np.ndarray, offsets: np.ndarray, before: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts with ``before`` bytes put in front of each, and where each padded text starts."""
    n = len(offsets) - 1
    start = offsets + before * np.arange(n + 1)
    out = np.full(len(data) + before * n, fill, dtype=np.uint8)
    keep = np.ones(len(out), dtype=bool)
    for b in range(before):
        keep[start[:-1] + b] = False
    out[keep] = data
    return out, start


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte of the texts, the byte and the ``order`` bytes before it as one integer."""
    ext, start = padded(data, offsets, order, START)
    key = np.zeros(max(len(ext) - order, 0), dtype=U)
    for j in range(order + 1):
        key = key << U(8) | ext[j:len(ext) - order + j]
    keep = np.ones(len(key), dtype=bool)
    for b in range(order):                       # grams that would end in the next text's padding
        at = start[1:-1] - order + b
        keep[at[at >= 0]] = False
    return key[keep] if len(data) else key[:0]


class Table:
    """Hash table from integer keys to row numbers, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        self.key = np.full(1 << self.bits, _NONE, dtype=U)
        self.row = np.full(1 << self.bits, -1, dtype=np.int32)
        self._put(keys, 0)

    def _put(self, keys: np.ndarray, first: int) -> None:
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.row[at] < 0
            self.row[at[free]] = left[free] + first      # the last writer of a slot keeps it
            self.key[at[free]] = keys[left[free]]
            lost = self.row[at] != left + first
            at, left = (at[lost] + 1) & ((1 << self.bits) - 1), left[lost]

    def extended(self, keys: np.ndarray, new: int) -> Table:
        """The table with the last ``new`` of ``keys`` added, whose rows follow those it has."""
        if 2 * len(keys) > 1 << self.bits:
            return Table(keys)
        self._put(keys[len(keys) - new:], len(keys) - new)
        return self

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = self._slot(keys)
        got = self.key[at]
        out = np.where(got == keys, self.row[at], -1)
        open_ = np.flatnonzero((got != keys) & (got != _NONE))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            got = self.key[at[open_]]
            same = got == keys[open_]
            out[open_[same]] = self.row[at[open_[same]]]
            open_ = open_[~same & (got != _NONE)]
        return out


class Trees:
    """Frozen context trees of several languages over shared keys."""

    def __init__(self, languages: list[str], order: int, keys: np.ndarray, lang: np.ndarray, counts: np.ndarray):
        """``keys``: grams of ``order`` + 1 bytes, with the language and the count of each."""
        self.languages, self.order = languages, order
        size = len(languages)
        levels = []
        for d in range(order, -1, -1):
            own = keys & U((1 << (8 * (d + 1))) - 1)
            key, row = np.unique(own, return_inverse=True)
            table = np.zeros((len(key), size))
            np.add.at(table, (row, lang), counts)
            levels.append((key, table))
        self.bits: list[np.ndarray] = []         # code lengths in bits of seen grams, by level
        self.escape: list[np.ndarray] = []       # bits of leaving a context, by level
        self.gram: list[Table] = []
        self.context: list[Table] = []
        below = np.full((256, size), 8.0)
        find_below = lambda k: k.astype(np.int64)
        for d, (key, n) in enumerate(reversed(levels)):
            ctx, at = np.unique(key >> U(8), return_inverse=True)
            total, kinds = np.zeros((len(ctx), size)), np.zeros((len(ctx), size))
            np.add.at(total, at, n)
            np.add.at(kinds, at, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(n / (total + kinds)[at])
            lower = below[find_below(key & U((1 << (8 * d)) - 1) if d else key)]
            bits = np.where(n > 0, seen, leave[at] + lower)
            self.bits.append(bits.astype(np.float32))
            self.escape.append(np.concatenate([leave, np.zeros((1, size))]).astype(np.float32))
            self.gram.append(Table(key))
            self.context.append(Table(ctx))
            below, find_below = bits, self.gram[-1].find

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        key = grams(data, offsets, self.order)
        step = max(1 << 12, CELLS_AT_ONCE // max(len(self.languages), 1))
        for lo in range(0, len(key), step):         # a long text is scored a part at a time
            bits = self._bits(key[lo:lo + step])
            at = np.clip(offsets, lo, lo + len(bits)) - lo
            full = np.flatnonzero(np.diff(at))
            out[full] += np.add.reduceat(bits, at[full], axis=0, dtype=np.float64)
        return out

    def _bits(self, key: np.ndarray) -> np.ndarray:
        """Bits of each byte, given by its gram, under each language."""
        size = len(self.languages)
        bits = np.empty((len(key), size), dtype=np.float32)
        row = self.gram[self.order].find(key)
        hit = row >= 0
        bits[hit] = self.bits[self.order][row[hit]]
        left = np.flatnonzero(~hit)
        cost, key = np.zeros((len(left), size), np.float32), key[left]
        for d in range(self.order, -1, -1):
            if d < self.order:
                row = self.gram[d].find(key)
                hit = row >= 0
                bits[left[hit]] = cost[hit] + self.bits[d][row[hit]]
                left, cost, key = left[~hit], cost[~hit], key[~hit]
            cost = cost + self.escape[d][self.context[d].find(key >> U(8))]
            key = key & U((1 << (8 * d)) - 1)
        bits[left] = cost + np.float32(8)
        return bits


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                key = grams(data, offsets, order)
                names, lang = np.unique(part.column("lang").to_pylist(), return_inverse=True)
                lang = np.repeat(lang, np.diff(offsets))
                for i, name in enumerate(names):
                    found, n = np.unique(key[lang == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)],
                                                     ["lang", "gram", "n"])
    return run


def sample(labelled: DataFrame, sample_bytes: int) -> DataFrame | None:
    """``(lang, text)`` of the training sample; None without a labelled text.

    Copies of a text count once, in the size of its language as in the sample; what reaches the driver is
    one row a language.
    """
    rows = labelled.filter("lang is not null and text is not null").select(
        "lang", "text", F.xxhash64("text").bitwiseAND(F.lit(MOST)).alias("h"))
    once = rows.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("n"))
    bound = {r.lang: max(r.least, MOST if r.n <= sample_bytes else MOST * sample_bytes // r.n)
             for r in once.groupBy("lang").agg(F.sum("n").alias("n"), F.min("h").alias("least")).collect()}
    if not bound:
        return None
    upto = F.element_at(F.create_map(*[F.lit(x) for kv in bound.items() for x in kv]), F.col("lang"))
    drawn = rows.filter(F.col("h") <= upto).withColumn("text", F.substring("text", 1, sample_bytes))
    return drawn.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def train(labelled: DataFrame, order: int, sample_bytes: int, max_cells: int = MAX_CELLS) -> Trees:
    """Trees from a sample of ``(lang, text)`` rows."""
    drawn = sample(labelled, sample_bytes)
    if drawn is None:
        return Trees([], order, np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0))
    counted = staged(drawn.mapInArrow(_count(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    names = sorted(r.lang for r in labelled.filter("lang is not null and text is not null").select("lang").distinct().collect())     # as many as labels
    often = (counted.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(max(1, max_cells // len(names))))
    kept = counted.join(often.select("gram"), "gram").toArrow()
    lang = np.searchsorted(names, kept.column("lang").to_pylist()) if kept.num_rows else np.zeros(0, np.int64)
    return Trees(names, order, kept.column("gram").to_numpy().view(U), lang, kept.column("n").to_numpy().astype(float))


def _predict(trees, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Trees = trees.value
        for batch in batches:
            for part in slices(batch, "text", max(1 << 12, min(CHUNK_BYTES, CELLS_AT_ONCE // max(len(model.languages), 1)))):
                bits = model.code_lengths(*utf8(part.column("text")))
                letters = np.array([bool(t and LETTER.search(t)) for t in part.column("text").to_pylist()])
                names, scores = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if model.languages:
                    best = bits.argmin(axis=1)
                    with np.errstate(over="ignore", under="ignore"):
                        odds = np.exp2(-(bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
                    scores = np.where(letters, 1 / odds, 0.0)
                    names = [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                    names=[id_name, "held_out", "lang_pred", "score"])
    return run


def identify_language(documents: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                      lang_col: str = "lang", order: int = 4, sample_bytes: int = 2_000_000) -> DataFrame:
    """Predict the language of every whole text; learn from rows that are not ``held_out``.

    Returns the id, ``held_out``, ``lang_pred`` and ``score``, the posterior probability of the
    predicted language if all are equally likely beforehand. Only the text enters a prediction.
    Ties go to the first language by name. Text that is null or has no letter, or a table without
    any labelled row to learn from, gives ``und`` and 0; rows with a null language are predicted but
    not learned from; other columns are not read; an empty table gives an empty result. Repeated rows get equal
    rows, and copies are learned from once. A very long text is held whole and scored a part at a time.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                            F.col(lang_col).cast("string").alias("lang"), held_out.alias("held_out"))
    trees = spark.sparkContext.broadcast(train(rows.filter("not held_out").select("lang", "text"), order, sample_bytes))
    schema = T.StructType([T.StructField(id_col, field(documents, id_col).dataType), T.StructField("held_out", T.BooleanType()),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.select("id", "text", "held_out").mapInArrow(_predict(trees, id_col), schema)
