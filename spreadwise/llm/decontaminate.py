"""Operator 10: benchmark decontamination by winnowing.

Texts and items are winnowed alike: of every ``window`` consecutive words, the ``k``-gram with the
smallest hash (leftmost on ties) is a fingerprint, so any shared window shares a fingerprint at the
same place of the window. Fingerprints are joined, and each hit is extended word by word into its
neighbourhood of ``window - k`` words on either side; ``window`` equal words in a row are a match.
An item shorter than a window is one window of its own length and has one fingerprint, its whole.

The texts are read once. A bitmap of fixed size (``BITMAP_BITS``) made of the items' fingerprints
drops most of the texts' fingerprints before they leave the task; it never drops a true one, at any
number of items. What remains carries its neighbourhood, so texts are never shuffled. Spark
broadcasts the items' table in the join only if its size allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import field, keyed, row_key, staged
from .superkmers import ragged
from .text import NOT_ALNUM, Prefix, U, Words, as_signed, covered, lower_ascii, mix64, slices, sliding_min, utf8

BITMAP_BITS = 1 << 22
_POS = U((1 << 24) - 1)
_CHUNK = 1 << 22


def alnum_words(part: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased alphanumeric words of a slice, and the texts' bounds in words."""
    data, offsets = utf8(part.column(text))
    words = Words(lower_ascii(data), offsets, NOT_ALNUM)
    return words.hashes(), words.bounds


def winnow(codes: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in units of the slice), texts and hashes of the fingerprints."""
    places = []
    step = len(codes) if len(codes) <= _CHUNK else _CHUNK
    for lo in range(0, max(len(codes), 1), max(step, 1)):
        hi = min(len(codes), lo + step + window - 1)
        inner = np.clip(bounds, lo, hi) - lo
        sizes = np.maximum(np.diff(inner) - window + 1, 0)
        if not sizes.sum():
            continue
        grams = Prefix(codes[lo:hi]).windows(k)
        least = sliding_min((grams & ~_POS) | np.arange(len(grams), dtype=U), window - k + 1)
        start = np.arange(sizes.sum()) + np.repeat(inner[:-1] - (np.cumsum(sizes) - sizes), sizes)
        at = (least[start] & _POS).astype(np.int64)
        places.append(at[np.concatenate([[True], at[1:] != at[:-1]])] + lo)
    place = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
    doc = np.searchsorted(bounds, place, side="right") - 1
    p = Prefix(codes)
    return place, doc, mix64(mix64(p.of(place, place + k)) ^ U(k))


def neighbourhood(codes: np.ndarray, bounds: np.ndarray, place, doc, window: int, k: int, outside: int) -> np.ndarray:
    """Word hashes of [place - side, place + k + side) in each row; ``outside`` beyond the text."""
    side = window - k
    at = place[:, None] + np.arange(-side, k + side)[None, :]
    inside = (at >= bounds[doc][:, None]) & (at < bounds[doc + 1][:, None])
    got = codes[np.clip(at, 0, max(len(codes) - 1, 0))] if len(codes) else np.zeros(at.shape, U)
    return np.where(inside, got, U(outside))


def _list_array(flat: np.ndarray, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _item_rows(window: int, k: int):
    """``(fp, size, item, words)``: size is ``window``, or the length of a shorter item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                codes, bounds = alnum_words(part, "text")
                place, doc, fp = winnow(codes, bounds, window, k)
                around = neighbourhood(codes, bounds, place, doc, window, k, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_signed(fp)), pa.array(np.full(len(fp), window, np.int32)), part.column("item").take(pa.array(doc)),
                     _list_array(as_signed(around).ravel(), np.full(len(fp), around.shape[1] if len(fp) else 0))],
                    ["fp", "size", "item", "words"])
                lengths = np.diff(bounds)
                short = np.flatnonzero((lengths > 0) & (lengths < window))
                p = Prefix(codes)
                lo, hi = bounds[short], bounds[short + 1]
                fp = mix64(mix64(p.of(lo, hi)) ^ (hi - lo).astype(U))
                flat = np.concatenate([codes[x:y] for x, y in zip(lo, hi, strict=True)]) if len(short) else codes[:0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_signed(fp)), pa.array((hi - lo).astype(np.int32)), part.column("item").take(pa.array(short)),
                     _list_array(as_signed(flat), hi - lo)], ["fp", "size", "item", "words"])
    return run


def _text_rows(window: int, k: int, lengths: list[int], bitmap):
    """One row for each text: its number of words and the fingerprints that may be an item's."""
    def may_be(fp: np.ndarray) -> np.ndarray:
        bits = bitmap.value
        at = fp & U(BITMAP_BITS - 1)
        return (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                codes, bounds = alnum_words(part, "text")
                place, doc, fp = winnow(codes, bounds, window, k)
                keep = may_be(fp)
                place, doc, fp = place[keep], doc[keep], fp[keep]
                around = neighbourhood(codes, bounds, place, doc, window, k, 0)
                found = [(doc, place, fp, np.full(len(fp), window), around.ravel(), np.full(len(fp), window * 2 - k))]
                prefix = Prefix(codes)
                for n in lengths:
                    at = np.arange(max(len(codes) - n + 1, 0))
                    of = np.searchsorted(bounds, at, side="right") - 1
                    ok = at + n <= bounds[of + 1]
                    at, of = at[ok], of[ok]
                    fp = mix64(mix64(prefix.of(at, at + n)) ^ U(n))
                    ok = may_be(fp)
                    at, of, fp = at[ok], of[ok], fp[ok]
                    found.append((of, at, fp, np.full(len(fp), n), codes[(at[:, None] + np.arange(n)[None, :])].ravel() if len(fp) else codes[:0], np.full(len(fp), n)))
                doc, place, fp, size, flat, width = (np.concatenate(x) for x in zip(*found, strict=True))
                lists = _list_array(as_signed(flat), width)
                order = np.argsort(doc, kind="stable")
                struct = pa.StructArray.from_arrays(
                    [pa.array(as_signed(fp[order])), pa.array(size[order].astype(np.int32)),
                     pa.array((place - bounds[doc])[order]), lists.take(pa.array(order))], ["fp", "size", "lo", "words"])
                hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))]).astype(np.int32)), struct)
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), part.column("id"), pa.array(np.diff(bounds)), hits],
                                                 ["k1", "k2", "id", "n_words", "hits"])
    return run


def _extend(window: int, k: int):
    """Joined fingerprints to matched word ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column("size"))
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                part = batch.take(pa.array(rows))
                own = np.asarray(part.column("words").flatten()).reshape(len(rows), -1)
                item = np.asarray(part.column("item_words").flatten()).reshape(len(rows), -1)
                same = own == item
                lo = np.asarray(part.column("lo"))
                if n < window:
                    ok, left, right = same.all(axis=1), 0, int(n)
                else:
                    side = window - k
                    left = np.cumprod(same[:, :side][:, ::-1], axis=1).sum(axis=1)
                    right = np.cumprod(same[:, side:], axis=1).sum(axis=1)
                    ok = (right >= k) & (left + right >= window)
                hit = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1").take(hit), part.column("k2").take(hit), pa.array((lo - left)[ok]),
                     pa.array((lo + right)[ok]), part.column("item").take(hit)], ["k1", "k2", "lo", "hi", "item"])
    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, at = ragged(batch.column("spans"))
        lo, hi = np.asarray(spans.field("lo")), np.asarray(spans.field("hi"))
        out = []
        for i in range(batch.num_rows):
            s, e = lo[at[i]:at[i + 1]], hi[at[i]:at[i + 1]]
            mask = covered(int(e.max()), s, e)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)
            out.append([{"lo": int(x), "hi": int(y)} for x, y in edge])
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(out, kind), batch.column("items")],
                                         ["k1", "k2", "hit_spans", "items"])


def _bitmap(items: DataFrame) -> np.ndarray:
    """Bits of the items' fingerprints; at most BITMAP_BITS / 64 rows reach the driver."""
    at = F.col("fp").bitwiseAND(F.lit(BITMAP_BITS - 1))
    rows = (items.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast((fp & 63) as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    for r in rows:
        out[r.word] = r.bits
    return out.view(U)


def find_benchmark_spans(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """Words of each text that stand in a window of a benchmark item.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. Returns one row
    for each input row: the id, ``n_words``, ``n_hit`` (words inside any occurrence),
    ``hit_spans`` (maximal runs as word ranges) and ``items`` (sorted distinct ids, as text, of the
    items with an occurring window). Other columns are not read.

    Null text has no words; an item without words matches nothing; an item with a null id marks
    words but is not listed; repeated items count once for each distinct id; empty tables give no
    rows or no hits.
    """
    texts, merged = _matches(documents, benchmark, id_col, text_col, item_col, item_text_col, window, k)
    empty_items, empty_spans = F.array().cast("array<string>"), F.array().cast(_SPANS)
    out = texts.select("k1", "k2", "id", "n_words").join(merged, ["k1", "k2"], "left")
    spans = F.coalesce("hit_spans", empty_spans)
    return out.select(
        F.col("id").alias(id_col), "n_words",
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"]).alias("n_hit"),
        spans.alias("hit_spans"), F.coalesce("items", empty_items).alias("items"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", window: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``documents``, with all their columns, without a word that ``find_benchmark_spans`` hits.

    Rows with null or empty text stay, repeated rows stay or go together, an empty table (of either kind) drops
    nothing, and columns of any name pass through. A very long text is judged whole.
    """
    _, merged = _matches(documents, benchmark, id_col, text_col, item_col, item_text_col, window, k)
    hit = staged(merged.select("k1", "k2"), "contaminated")
    rows = documents.select(*row_key(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    return rows.join(hit, ["k1", "k2"], "left_anti").select("row.*")


_SPANS = T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))


def _matches(documents: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str,
             window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """All texts ``(k1, k2, id, n_words)``, and matched ones ``(k1, k2, hit_spans, items)``."""
    spark = documents.sparkSession
    item_type = field(benchmark, item_col).dataType
    items = staged(benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).mapInArrow(
        _item_rows(window, k), T.StructType([
            T.StructField("fp", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("item", item_type),
            T.StructField("words", T.ArrayType(T.LongType()))])), "items")
    lengths = sorted(r.size for r in items.filter(F.col("size") < window).select("size").distinct().collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(items))
    id_type = field(documents, id_col).dataType
    hit = T.StructType([T.StructField("fp", T.LongType()), T.StructField("size", T.IntegerType()),
                        T.StructField("lo", T.LongType()), T.StructField("words", T.ArrayType(T.LongType()))])
    key = [T.StructField("k1", T.LongType()), T.StructField("k2", T.IntegerType())]
    texts = staged(keyed(documents, id_col, text_col).mapInArrow(_text_rows(window, k, lengths, bitmap), T.StructType(
        [*key, T.StructField("id", id_type), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(hit))])), "fingerprints")
    hits = texts.select("k1", "k2", F.explode("hits").alias("h")).select("k1", "k2", "h.*")
    pairs = hits.join(items.withColumnRenamed("words", "item_words"), ["fp", "size"])
    matched = pairs.select("k1", "k2", "size", "lo", "words", "item_words", "item").mapInArrow(_extend(window, k), T.StructType(
        [*key, T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("item", item_type)]))
    by_text = matched.groupBy("k1", "k2").agg(
        F.collect_set(F.struct("lo", "hi")).alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    return texts, by_text.mapInArrow(_merge, T.StructType([*key, T.StructField("hit_spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))]))
