"""Super-k-mers: the compact form in which repeated windows are searched.

A window of ``window`` units (words or bytes) holds ``window - k + 1`` k-grams; the one with the
smallest hash (leftmost on ties) is its anchor. The choice depends on the window's content only,
so two equal windows have equal anchors at equal places. Consecutive windows with one anchor form
a super-k-mer, one row instead of up to ``window - k + 1``. Windows under different anchor hashes
are never equal, which makes every later step local to an anchor:

1. anchors that occur once cannot hold a repeated window and go (``repeated_super_kmers``);
2. a super-k-mer whose whole content occurs twice is repeated throughout (``classes``);
3. the rest, super-k-mers seen once whose anchor branches into several contents, must be compared
   window by window; that is the part in which the operators differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import reshuffled, staged
from .text import BYTE_CODES, Prefix, U, Words, as_signed, mix64, slices, sliding_min, utf8

PIECE = 1 << 21
_POS = U((1 << 22) - 1)


@dataclass(frozen=True)
class Shape:
    """What a window is: ``unit`` "word" or "byte", its size, and the anchor's size."""

    unit: str
    window: int
    k: int


@dataclass
class Runs:
    """Super-k-mers of a slice: text number, ordinal in the text, first and last window start,
    anchor hash and content hash. Positions count units from the text's begin."""

    doc: np.ndarray
    ordinal: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def units(part: pa.RecordBatch, shape: Shape):
    """Unit codes of a slice as a function of a range, and the texts' bounds in units."""
    data, offsets = utf8(part.column("text"))
    if shape.unit == "byte":
        return (lambda lo, hi: BYTE_CODES[data[lo:hi]]), offsets
    words = Words(data, offsets)
    codes = words.hashes()
    return (lambda lo, hi: codes[lo:hi]), words.bounds


def find_runs(codes, bounds: np.ndarray, shape: Shape) -> Runs:
    """Super-k-mers of all texts of a slice. A text of over ``PIECE`` units stands alone in its
    slice and is cut into pieces that overlap by a window less one."""
    n = int(bounds[-1])
    parts = []
    step = n if n <= PIECE * 3 // 2 else PIECE
    for lo in range(0, max(n, 1), max(step, 1)):
        hi = min(n, lo + step + shape.window - 1)
        parts.append(_runs(codes(lo, hi), np.clip(bounds, lo, hi) - lo, lo, shape))
    doc, first, last, anchor, content = (np.concatenate(x) for x in zip(*parts, strict=True))
    begin = np.searchsorted(doc, np.arange(len(bounds) - 1))
    return Runs(doc, np.arange(len(doc)) - begin[doc], first - bounds[doc], last - bounds[doc], anchor, content)


def _runs(codes: np.ndarray, bounds: np.ndarray, base: int, shape: Shape):
    sizes = np.maximum(np.diff(bounds) - shape.window + 1, 0)
    total = int(sizes.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(U), none.view(U)
    prefix = Prefix(codes)
    grams = prefix.windows(shape.k)
    packed = (grams & ~_POS) | np.arange(len(grams), dtype=U)
    least = sliding_min(packed, shape.window - shape.k + 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(total) + (bounds[:-1] - (np.cumsum(sizes) - sizes))[doc]
    anchor = (least[start] & _POS).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1          # texts never share an anchor's place
    head, tail = np.concatenate([[0], cut]), np.concatenate([cut, [total]]) - 1
    first, last, at = start[head], start[tail], anchor[head]
    raw = prefix.of(first, last + shape.window)
    content = mix64(raw ^ mix64(((at - first) << 32 | (last - first)).astype(U)))
    return doc[head], first + base, last + base, grams[at], content


def _emit_anchors(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                runs = find_runs(*units(part, shape), shape)
                k1, k2 = (np.asarray(part.column(c)) for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_signed(runs.anchor)), pa.array(k1[runs.doc]),
                     pa.array(k2[runs.doc].astype(np.int64) << 32 | runs.ordinal)], ["a", "k1", "x"])
    return run


def ragged(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.nan_to_num(np.asarray(column.value_lengths().fill_null(0))).astype(np.int64)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def _emit_contents(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                runs = find_runs(*units(part, shape), shape)
                values, offsets = ragged(part.column("ordinals"))
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                begin = np.searchsorted(runs.doc, np.arange(part.num_rows))
                at = begin[row] + np.asarray(values)
                k1, k2 = (np.asarray(part.column(c)) for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_signed(runs.anchor[at])), pa.array(as_signed(runs.content[at])),
                     pa.array(k1[row]), pa.array(k2[row]), pa.array(runs.first[at]),
                     pa.array((runs.last - runs.first)[at].astype(np.int32) + 1)],
                    ["a", "s", "k1", "k2", "first", "n"])
    return run


def repeated_super_kmers(docs: DataFrame, shape: Shape) -> DataFrame:
    """Super-k-mers whose anchor occurs at least twice: ``(a, s, k1, k2, first, n)``, staged.

    The counts are combined map-side, so an anchor in a third of all texts is a few rows when it is
    shuffled; the semi-join that follows may be split by the adaptive skew join.
    """
    anchors = docs.select("k1", "k2", "text").mapInArrow(_emit_anchors(shape), "a long, k1 long, x long")
    often = anchors.groupBy("a").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(reshuffled("a"))
    wanted = (anchors.join(often, "a", "left_semi")
              .groupBy("k1", F.shiftright("x", 32).cast("int").alias("k2"))
              .agg(F.collect_set(F.col("x").bitwiseAND(F.lit(0xFFFFFFFF))).alias("ordinals")))
    texts = docs.select("k1", "k2", "text")
    found = texts.join(wanted, ["k1", "k2"]).mapInArrow(
        _emit_contents(shape), "a long, s long, k1 long, k2 int, first long, n int")
    return staged(found, "superkmers")


def classes(found: DataFrame) -> DataFrame:
    """One row for each content ``(a, s)``: how often it occurs, and its least place."""
    return found.groupBy("a", "s").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("k1", "k2", "first", "n")).alias("at"))


def whole_spans(found: DataFrame, shape: Shape) -> DataFrame:
    """Spans ``(k1, k2, lo, hi)`` of the super-k-mers whose whole content occurs at least twice."""
    often = found.groupBy("a", "s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(reshuffled("a"), reshuffled("s"))
    return found.join(often, ["a", "s"], "left_semi").select(
        "k1", "k2", F.col("first").alias("lo"),
        (F.col("first") + F.col("n") - 1 + shape.window).alias("hi"))


def branching(found: DataFrame) -> DataFrame:
    """Contents under anchors with several contents: ``(a, s, c, at)``."""
    kinds = classes(found)
    several = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    return kinds.join(several, "a")


def spans_by_text(spans: DataFrame) -> DataFrame:
    """Spans gathered for each text (a list bounded by the text's own length)."""
    return spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
