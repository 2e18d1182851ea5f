"""Operator 13: ranked lexical search, hybrid term-at-a-time / document-at-a-time.

An index segment holds a few megabytes of whole texts: document ids and lengths, and for each term
the list of its documents with frequencies. Segments are built where the texts are read and each is
one row of a staged table, so postings are never shuffled. Document frequencies are a sum over the
segments' list lengths.

A segment is searched for one item after another. The item's short lists are summed term at a time
into accumulators. These then act as one more list, with a bound for each block of documents, beside
the long lists: blocks are walked in document order, blocks whose bounds cannot reach the score of
the k-th best so far are skipped, and in the others the long lists are met in order of their bounds,
each by search from the candidates that can still get there. Best documents of a segment meet those of
the others in two steps, so no task ranks more than a share.

Items are taken in blocks of bounded size, each block against all segments. Only a block's terms and
weights are sent to the tasks. A bitmap of fixed size keeps most terms that no item has out of the
index; terms are compared as text in the end, so a false hit of the bitmap costs space only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import field, staged
from .text import NOT_ALNUM, U, Words, as_signed, lower_ascii, slices, utf8

SEGMENT_BYTES = 8 << 20
ITEM_BLOCK_BYTES = 4 << 20
BITMAP_BITS = 1 << 22
DOC_BLOCK = 64          # documents with one bound
STRIDE = 32             # blocks that are walked before the threshold is raised
SHORT_SHARE = 32        # a list is short if it holds at most one document in so many
SHARES = 64             # first step of the final ranking


def terms_of(column: pa.Array) -> tuple[pa.Array, Words]:
    """Every term of every text, in order, as text, and where they stand."""
    data, offsets = utf8(column)
    data = lower_ascii(data)
    words = Words(data, offsets, NOT_ALNUM)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=at[1:])
    inside = data[~NOT_ALNUM[data]]
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(inside))), words


def bits_of(terms: pa.Array) -> np.ndarray:
    """Place of each (distinct) term in the bitmap."""
    data, offsets = utf8(terms)
    return as_signed(Words(data, offsets, NOT_ALNUM).hashes() & U(BITMAP_BITS - 1))


def _list(flat: pa.Array, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)


def _item_rows():
    """``(item, id, terms, bits)``: one row for each item with a term; item is a number of its own."""
    names = ["item", "id", "terms", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                terms, words = terms_of(part.column("text"))
                coded = terms.dictionary_encode()
                pairs = np.unique(words.doc * max(len(coded.dictionary), 1) + np.asarray(coded.indices))
                doc, code = np.divmod(pairs, max(len(coded.dictionary), 1))
                rows, sizes = np.unique(doc, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(number + rows), part.column("id").take(pa.array(rows)), _list(coded.dictionary.take(pa.array(code)).cast(pa.string()), sizes),
                    _list(pa.array(bits_of(coded.dictionary)[code]), sizes)], names)
                number += part.num_rows
    return run


def _segments(bitmap):
    """Texts to index segments."""
    names = ["segment", "ids", "lengths", "terms", "counts", "docs", "freqs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", SEGMENT_BYTES):
                terms, words = terms_of(part.column("text"))
                coded = terms.dictionary_encode()
                keep = wanted[bits_of(coded.dictionary)]
                codes = np.asarray(coded.indices)
                inside = keep[codes] if len(codes) else np.zeros(0, bool)
                pairs, freqs = np.unique(codes[inside].astype(np.int64) * part.num_rows + words.doc[inside], return_counts=True)
                code, doc = np.divmod(pairs, part.num_rows)
                kept, counts = np.unique(code, return_counts=True)
                one = lambda x, kind: _list(pa.array(x.astype(kind)), [len(x)])
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), _list(part.column("id"), [part.num_rows]), one(np.diff(words.bounds), np.int64),
                    _list(coded.dictionary.take(pa.array(kept)).cast(pa.string()), [len(kept)]), one(counts, np.int32), one(doc, np.int32), one(freqs, np.int64)], names)
                number += 1
    return run


class Segment:
    """Lists of the block's terms in one index segment, as contributions to a score."""

    def __init__(self, lengths: np.ndarray, terms: pa.Array, counts: np.ndarray, docs: np.ndarray, freqs: np.ndarray,
                 id_rank: np.ndarray, vocabulary: pa.Array, weights: np.ndarray, n_docs: int, n_terms: int):
        self.size, self.id_rank = len(lengths), id_rank
        self.n_blocks = -(-self.size // DOC_BLOCK)
        norm = 20 * (50 + (50 * lengths * n_docs) // max(n_terms, 1))
        found = pc.index_in(terms, value_set=vocabulary)
        at = np.concatenate([[0], np.cumsum(counts)])
        self.lists: dict[int, tuple] = {}
        for i in np.flatnonzero(np.asarray(found.is_valid())):
            code = found[int(i)].as_py()
            if weights[code] <= 0:
                continue
            d, f = docs[at[i]:at[i + 1]], freqs[at[i]:at[i + 1]]
            gain = weights[code] * ((1_000_000_000 * f) // (1000 * f + norm[d]))
            bounds = None
            if len(d) * SHORT_SHARE > self.size:
                bounds = np.zeros(self.n_blocks, np.int64)
                np.maximum.at(bounds, d // DOC_BLOCK, gain)
            self.lists[code] = (d, gain, bounds)

    def best(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents (places in the segment) for an item, their scores, and how many documents were met."""
        mine = [self.lists[c] for c in codes.tolist() if c in self.lists]
        none = np.zeros(0, np.int64)
        if not mine:
            return none, none, 0
        summed = np.zeros(self.n_blocks * DOC_BLOCK, np.int64)
        for docs, gain, bounds in mine:
            if bounds is None:
                summed[docs] += gain
        long = sorted((x for x in mine if x[2] is not None), key=lambda x: -int(x[2].max()))
        bound = summed.reshape(-1, DOC_BLOCK).max(axis=1)
        floor = 1
        reached = summed[summed > 0]
        if len(reached) >= k:
            floor = max(floor, int(np.partition(reached, len(reached) - k)[-k]))
        for _, _, bounds in long:
            bound = bound + bounds
        rest = np.concatenate([np.cumsum([int(x[2].max()) for x in long][::-1])[::-1], [0]]).astype(np.int64)
        top, top_score, met = none, none, 0
        for lo in range(0, self.n_blocks, STRIDE):
            live = lo + np.flatnonzero(bound[lo:lo + STRIDE] >= floor)
            if not len(live):
                continue
            docs = (live[:, None] * DOC_BLOCK + np.arange(DOC_BLOCK)[None, :]).ravel()
            docs = docs[docs < self.size]
            score = summed[docs]
            met += len(docs)
            for i, (of, gain, _) in enumerate(long):
                ok = score + rest[i] >= floor
                docs, score = docs[ok], score[ok]
                at = np.minimum(np.searchsorted(of, docs), len(of) - 1)
                score = score + np.where(of[at] == docs, gain[at], 0)
            ok = score >= floor
            top, top_score = np.concatenate([top, docs[ok]]), np.concatenate([top_score, score[ok]])
            if len(top) > k:
                order = np.lexsort((self.id_rank[top], -top_score))[:k]
                top, top_score = top[order], top_score[order]
                floor = max(floor, int(top_score[-1]))
        return top, top_score, met


def _block(pairs: pd.DataFrame) -> tuple:
    """Terms, their weights, items, and the bounds and codes of each item's terms, of ``(item, term, w)``."""
    terms = pairs.drop_duplicates("term").sort_values("term")
    pairs = pairs.sort_values("item", kind="stable")
    codes = np.asarray(pd.Index(terms["term"]).get_indexer(pairs["term"]))
    items, sizes = np.unique(pairs["item"].to_numpy(np.int64), return_counts=True)
    return terms["term"].tolist(), terms["w"].to_numpy(np.int64), items, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), codes


def _search(block, k: int, n_docs: int, n_terms: int):
    """Segments to ``(item, id, score, share)``: the k best documents of each segment for each item of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, items, bounds, codes = block.value
        vocabulary = pa.array(terms, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                row = lambda c, i=i: batch.column(c).slice(i, 1).flatten()
                ids = row("ids")
                rank = np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first")).astype(np.int64)
                segment = Segment(np.asarray(row("lengths")), row("terms"), np.asarray(row("counts")), np.asarray(row("docs")), np.asarray(row("freqs")),
                                  rank, vocabulary, weights, n_docs, n_terms)
                found = [segment.best(codes[bounds[j]:bounds[j + 1]], k)[:2] for j in range(len(items))]
                sizes = [len(d) for d, _ in found]
                docs = np.concatenate([d for d, _ in found]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(items, sizes)), ids.take(pa.array(docs)), pa.array(np.concatenate([s for _, s in found]).astype(np.int64)),
                    pa.array(np.full(len(docs), batch.column("segment")[i].as_py() % SHARES, np.int32))], ["item", "id", "score", "share"])
    return run


def _bitmap(items: DataFrame) -> bytes:
    """Bits of the items' terms; at most BITMAP_BITS / 64 rows reach the driver."""
    rows = (items.select(F.explode("bits").alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    for r in rows:
        out[r.word] = r.bits
    return out.tobytes()


def search_ranked(documents: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", block_bytes: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: ``(item, rank, document, score)``.

    Terms are runs of ASCII letters (lower-cased), digits and non-ASCII characters. With N documents that
    have a term, L terms in them, n terms in a document, a term's df documents and its tf occurrences in
    a document, a document scores, for each distinct term of the item, floor(1000 ln((2N + 2) / (2 df + 1)))
    times (1e9 tf) div (1000 tf + 20 (50 + 50 n N div L)), in 64-bit integers. Equal scores rank by
    ascending document id, nulls last. Only scores above 0 count.

    Null text has no terms. A document without terms is never found, an item without terms finds nothing,
    a repeated document or item row counts and ranks as a row of its own (rows alike in every column come
    in any order), and an empty table gives no rows. A text is held whole by the task that reads it, and a
    very long one is a segment by itself. Other columns are not read, whatever their names.
    """
    spark = documents.sparkSession
    id_type, item_type = field(documents, id_col).dataType, field(items, item_col).dataType
    array = T.ArrayType
    asked = staged(items.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text")).mapInArrow(
        _item_rows(), T.StructType([T.StructField("item", T.LongType()), T.StructField("id", item_type),
                                             T.StructField("terms", array(T.StringType())), T.StructField("bits", array(T.LongType()))])), "asked")
    bitmap = spark.sparkContext.broadcast(_bitmap(asked))
    index = staged(documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _segments(bitmap), T.StructType([
            T.StructField("segment", T.LongType()), T.StructField("ids", array(id_type)), T.StructField("lengths", array(T.LongType())),
            T.StructField("terms", array(T.StringType())), T.StructField("counts", array(T.IntegerType())),
            T.StructField("docs", array(T.IntegerType())), T.StructField("freqs", array(T.LongType()))])), "index")

    totals = index.select(F.size(F.filter("lengths", lambda n: n > 0)).alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n).alias("l")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum("l"), F.lit(0)).cast("long").alias("l")).first()
    df = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
    weights = df.select(F.col("terms").alias("term"), F.floor(1000 * F.log((2.0 * totals.n + 2) / (2 * F.col("df") + 1))).cast("long").alias("w"))
    words = asked.select("item", F.explode("terms").alias("term"))
    weights = staged(weights.join(words.select("term").distinct(), "term"), "weights")

    size = asked.select(F.aggregate("terms", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t) + 16).alias("b")).agg(F.sum("b")).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    def ranked(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("id", id_type), T.StructField("score", T.LongType()), T.StructField("share", T.IntegerType())])
    found = None
    for b in range(n_blocks):   # one block's terms at a time on the driver and in the tasks
        pairs = words.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).join(weights, "term").toPandas()
        if not len(pairs):
            continue
        block = spark.sparkContext.broadcast(_block(pairs))
        best = staged(ranked(index.mapInArrow(_search(block, k, totals.n, totals.l), schema), "item", "share").drop("rank"), "best")
        block.destroy()
        found = best if found is None else found.unionByName(best)

    if found is None:
        found = spark.createDataFrame([], schema)
    top = ranked(found, "item").select("item", "rank", F.col("id").alias("doc"), "score")
    return top.join(asked.select("item", F.col("id").alias("of")), "item").select(
        F.col("of").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
