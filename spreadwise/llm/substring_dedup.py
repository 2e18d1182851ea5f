"""Operator 1: substring deduplication on a compacted De Bruijn graph of word k-mers.

Nodes are runs of ``window - 1`` words and every window of ``window`` words is an edge. The graph
is built in the partitioned way: edges go to buckets by their anchor (``superkmers``), and the
edges of one super-k-mer are a path. A path whose content occurs several times and is the only
content under its anchor is nonbranching: it stays compacted, one row for all its edges. Where an
anchor branches, the paths are unfolded into their edges, each distinct path once, and the edges
are counted by a grouped join. The repeated edges go back to source coordinates, where adjoining
ones are glued into maximal spans.

Results are exact up to collisions of 128 hash bits (anchor and content of each path or edge).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import field, keyed, staged
from .superkmers import Shape, branching, ragged, repeated_super_kmers, spans_by_text, units, whole_spans
from .text import Prefix, Words, as_signed, covered, slices, utf8


def _unfold(shape: Shape):
    """Edges of the wanted paths of each text: ``(a, e, k1, k2, lo, alone)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                codes, bounds = units(part, shape)
                edges = Prefix(codes(0, int(bounds[-1]))).windows(shape.window)
                paths, offsets = ragged(part.column("paths"))
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                first, n, a, alone = (np.asarray(paths.field(c)) for c in ("first", "n", "a", "alone"))
                each = np.repeat(np.arange(len(row)), n)
                lo = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                k1, k2 = (np.asarray(part.column(c)) for c in ("k1", "k2"))
                row = row[each]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[each]), pa.array(as_signed(edges[bounds[row] + lo])), pa.array(k1[row]),
                     pa.array(k2[row]), pa.array(lo), pa.array(alone[each])],
                    ["a", "e", "k1", "k2", "lo", "alone"])
    return run


_RANGES = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _cut(id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                words = Words(data, offsets)
                spans, at = ragged(part.column("spans"))
                row = np.repeat(np.arange(part.num_rows), np.diff(at))
                base = words.bounds[:-1][row]
                gone = covered(len(words), base + np.asarray(spans.field("lo")), base + np.asarray(spans.field("hi")))
                total = np.concatenate([[0], np.cumsum(gone)])
                n_words, n_removed = np.diff(words.bounds), np.diff(total[words.bounds])
                raw = data.tobytes()
                kept, removed = [], []
                for i in range(part.num_rows):
                    lo, hi = words.bounds[i], words.bounds[i + 1]
                    keep = np.flatnonzero(~gone[lo:hi]) + lo
                    kept.append(b" ".join([raw[s:e] for s, e in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)]).decode())
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[lo:hi].view(np.int8), [0]])))
                    removed.append([{"lo": int(s), "hi": int(e)} for s, e in edge.reshape(-1, 2)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.string()),
                     pa.array(removed, _RANGES)], names=[id_name, "n_words", "n_removed", "kept_text", "removed"])
    return run


def remove_repeated_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                             window: int = 35, k: int = 18) -> DataFrame:
    """Remove every word covered by a ``window``-word sequence that also starts anywhere else.

    Words are runs of anything but ASCII white space. Returns one row for each input row:
    the id, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space) and
    ``removed`` (maximal removed runs as word ranges). Only the id and text columns are read, so
    other columns, whatever their names, do not matter.

    Null text has no words and gives an empty ``kept_text``; texts shorter than a window lose
    nothing; a null id is an id like any other; rows equal in id and text are repeats of each other;
    an empty table gives an empty result.
    """
    docs = keyed(documents, id_col, text_col)
    joined = docs.join(_repeated_spans(docs, window, k), ["k1", "k2"], "left").select("id", "text", "spans")
    schema = T.StructType([
        T.StructField(id_col, field(documents, id_col).dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])))])
    return joined.mapInArrow(_cut(id_col), schema)


def cut_repeated_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, k: int = 18) -> DataFrame:
    """The rows of ``documents``, with all their columns, after ``remove_repeated_passages``: a text
    that loses words becomes its kept words joined by one space, any other text stays as it is.

    Null and empty texts stay as they are; repeated rows are repeats of each other; a text of repeats only becomes
    empty, its row stays; an empty table gives an empty table; columns of any name pass through. A very long text
    is held whole by its task."""
    docs = keyed(documents, id_col, text_col, carry=True)
    joined = docs.join(_repeated_spans(docs, window, k), ["k1", "k2"], "left")
    # most rows have no span and need no Python
    cut = joined.filter("spans is not null").select(F.col("rest").alias("id"), "text", "spans").mapInArrow(_cut("rest"), T.StructType([
        field(docs, "rest"), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])))]))
    rows = cut.select("rest", F.col("kept_text").alias("text")).unionByName(joined.filter("spans is null").select("rest", "text"))
    return rows.select(*[(F.col("text") if c == text_col else F.col("rest").getField(c)).alias(c) for c in documents.columns])


def _repeated_spans(docs: DataFrame, window: int, k: int) -> DataFrame:
    """``(k1, k2, spans)``: word ranges covered by repeated windows, for texts that have any."""
    shape = Shape("word", window, k)
    found = repeated_super_kmers(docs, shape)
    texts = docs.select("k1", "k2", "text")
    paths = (branching(found).select("a", "at.*", (F.col("c") == 1).alias("alone"))
             .groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "n", "a", "alone")).alias("paths")))
    edges = staged(texts.join(paths, ["k1", "k2"]).mapInArrow(
        _unfold(shape), "a long, e long, k1 long, k2 int, lo long, alone boolean"), "edges")
    shared = edges.groupBy("a", "e").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("a", "e")
    single = (edges.filter("alone").join(shared, ["a", "e"], "left_semi")
              .select("k1", "k2", "lo", (F.col("lo") + window).alias("hi")))
    return spans_by_text(whole_spans(found, shape).unionByName(single))
