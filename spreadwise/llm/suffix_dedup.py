"""Operator 3: byte-exact substring deduplication by deep-shallow suffix sorting.

Only suffixes that may share ``window`` bytes with another one are sorted: those that start in a
super-k-mer (``superkmers``) seen once under an anchor with several contents. Super-k-mers whose
whole content recurs are known to be repeated and enter the sort once, as evidence.

The suffixes of one anchor are sorted together, cut at ``window`` bytes, in two phases that work on
all groups of a task at once: a multikey sort by 8-byte words down to a shallow depth, which ends
most groups, then, for groups that still agree, one blind-trie level per round: every member is
compared with the group's first suffix, which gives the depth at which it leaves that path, and the
members that leave at one depth with one branching word form the next groups. Members that never
leave are equal in all ``window`` bytes.

An anchor with more than ``crowd`` contents would make an unbounded group. Its suffixes are
counted instead as rows of a grouped aggregate keyed by two window hashes, which combines map-side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import field, keyed, staged
from .superkmers import Shape, classes, ragged, repeated_super_kmers, spans_by_text, whole_spans
from .text import BYTE_CODES, Prefix, U, as_signed, covered, mix64, slices, utf8

SHALLOW_WORDS = 4
BATCH_BYTES = 1 << 20


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by the keys (first is most significant), group number along that order,
    and group sizes."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    number = np.cumsum(new) - 1
    return order, number, np.bincount(number)


def _tied(rows: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in groups of at least two, in sorted order, with their group numbers."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    order, number, sizes = _groups(keys)
    keep = sizes[number] > 1
    return rows[order][keep], number[keep]


def equal_suffixes(text: np.ndarray, start: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Mask of the suffixes that agree with another of their group in ``window`` bytes."""
    hit = np.zeros(len(start), dtype=bool)
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    word = np.ndarray(len(padded) - 7, dtype=">u8", buffer=padded, strides=(1,))
    depths = [*range(0, window - 7, 8)] + ([window - 8] if window % 8 else [])   # the last word may overlap
    if window < 8:
        raise ValueError("window must be at least 8 bytes")
    rows, group = _tied(np.arange(len(start)), [group])
    for d in depths[:SHALLOW_WORDS]:                       # shallow: multikey sort
        rows, group = _tied(rows, [group, word[start[rows] + d].astype(U)])
    deep = depths[SHALLOW_WORDS:]
    while len(rows):                                       # deep: one blind-trie level
        lead = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([lead, [len(rows)]]))
        pivot = start[rows[np.repeat(lead, size)]]
        own = start[rows]
        leave = np.full(len(rows), len(deep))
        live = np.arange(len(rows))
        for j, d in enumerate(deep):
            live_same = word[own[live] + d] == word[pivot[live] + d]
            leave[live[~live_same]] = j
            live = live[live_same]
            if not len(live):
                break
        whole = leave == len(deep)
        together = np.add.reduceat(whole, lead)
        hit[rows[whole & np.repeat(together > 1, size)]] = True
        rest = np.flatnonzero(~whole)
        at = own[rest] + np.asarray(deep or [0])[np.minimum(leave[rest], max(len(deep) - 1, 0))]
        rows, group = _tied(rows[rest], [group[rest], leave[rest], word[at].astype(U)])
    return hit


def _cut_out(shape: Shape):
    """Bytes of the wanted super-k-mers: ``(a, k1, k2, first, n, lead, bytes, alone, crowded)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                raw = data.tobytes()
                paths, at = ragged(part.column("paths"))
                row = np.repeat(np.arange(part.num_rows), np.diff(at))
                first, n = np.asarray(paths.field("first")), np.asarray(paths.field("n"))
                lo = offsets[:-1][row] + first
                hi = lo + n - 1 + shape.window
                k1, k2 = (np.asarray(part.column(c)) for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays(
                    [paths.field("a"), pa.array(k1[row]), pa.array(k2[row]), pa.array(first), pa.array(n),
                     pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()),
                     paths.field("alone"), paths.field("crowded")],
                    ["a", "k1", "k2", "first", "n", "bytes", "alone", "crowded"])
    return run


def _sort_task(shape: Shape):
    def spans(table: pa.Table) -> pa.RecordBatch:
        data, offsets = utf8(table.column("bytes"))
        a, k1, k2, first, n, alone = (table.column(c).to_numpy() for c in ("a", "k1", "k2", "first", "n", "alone"))
        each = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        _, group = np.unique(a, return_inverse=True)
        hit = equal_suffixes(data, offsets[:-1][each] + j, group[each], shape.window) & alone.astype(bool)[each]
        edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
        # a run ends where the super-k-mer does
        new = np.concatenate([[True], each[1:] != each[:-1]]) if len(each) else np.zeros(0, bool)
        begin = np.flatnonzero(hit & (new | (edge[:-1] == 1)))
        last = np.flatnonzero(hit & (np.concatenate([new[1:], [True]]) | (edge[1:] == -1))) if len(each) else begin
        at = each[begin]
        return pa.RecordBatch.from_arrays(
            [pa.array(k1[at]), pa.array(k2[at]), pa.array(first[at] + j[begin]),
             pa.array(first[at] + j[last] + shape.window)], ["k1", "k2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "bytes", BATCH_BYTES):
                a = np.asarray(part.column("a"))
                # rows come sorted by anchor: the part's last anchor may go on in the next one
                cut = int(np.searchsorted(a, a[-1])) if size >= BATCH_BYTES else 0
                if cut == 0 and held and size >= BATCH_BYTES and held[-1].column("a")[-1].as_py() != a[0]:
                    yield spans(pa.Table.from_batches(held))
                    held, size = [], 0
                if cut:
                    yield spans(pa.Table.from_batches([*held, part.slice(0, cut)]))
                    held, size, part = [], 0, part.slice(cut)
                held.append(part)
                size += int(utf8(part.column("bytes"))[1][-1])
        if held:
            yield spans(pa.Table.from_batches(held))
    return run


def _count_task(shape: Shape):
    """Windows of crowded anchors as rows: two hashes, place, and whether the content stands alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "bytes", BATCH_BYTES):
                data, offsets = utf8(part.column("bytes"))
                a, k1, k2, first, n, alone = (part.column(c).to_numpy(zero_copy_only=False) for c in ("a", "k1", "k2", "first", "n", "alone"))
                each = np.repeat(np.arange(len(n)), n)
                j = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                at = offsets[:-1][each] + j
                h1 = Prefix(BYTE_CODES[data]).of(at, at + shape.window)
                h2 = Prefix(mix64(BYTE_CODES)[data]).of(at, at + shape.window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_signed(mix64(h1))), pa.array(as_signed(mix64(h2))), pa.array(k1[each]), pa.array(k2[each]),
                     pa.array(first[each] + j), pa.array(alone[each])], ["h1", "h2", "k1", "k2", "lo", "alone"])
    return run


def _remove(id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                spans, at = ragged(part.column("spans"))
                row = np.repeat(np.arange(part.num_rows), np.diff(at))
                base = offsets[:-1][row]
                gone = covered(len(data), base + np.asarray(spans.field("lo")), base + np.asarray(spans.field("hi")))
                total = np.concatenate([[0], np.cumsum(gone)])
                before = np.concatenate([[False], gone[:-1]])
                before[offsets[:-1][offsets[:-1] < len(data)]] = False
                runs = np.concatenate([[0], np.cumsum(gone & ~before)])
                kept, bounds = data[~gone], offsets - total[offsets]
                kept = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kept))])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])),
                     pa.array(np.diff(runs[offsets])), kept.cast(pa.binary())],
                    names=[id_name, "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def remove_repeated_bytes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          window: int = 200, k: int = 100, crowd: int = 2000) -> DataFrame:
    """Remove every byte covered by a ``window``-byte string that also starts anywhere else.

    Texts are UTF-8 bytes; a match never crosses texts. Returns one row for each input row: the id,
    ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (binary: the
    remaining bytes, which may end inside a character). Only the id and text columns are read.

    Null text is empty; texts shorter than a window lose nothing; rows equal in id and text are
    repeats of each other; a null id is an id like any other; an empty table gives an empty result.
    """
    shape = Shape("byte", window, k)
    docs = keyed(documents, id_col, text_col)
    found = repeated_super_kmers(docs, shape)
    kinds = classes(found)
    several = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    paths = (kinds.join(several, "a")
             .select("a", "at.*", (F.col("c") == 1).alias("alone"), (F.col("kinds") > crowd).alias("crowded"))
             .groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "n", "a", "alone", "crowded")).alias("paths")))
    pieces = staged(docs.select("k1", "k2", "text").join(paths, ["k1", "k2"]).mapInArrow(
        _cut_out(shape), "a long, k1 long, k2 int, first long, n int, bytes binary, alone boolean, crowded boolean"), "pieces")
    columns = ["a", "k1", "k2", "first", "n", "bytes", "alone"]
    sorted_spans = (pieces.filter("not crowded").select(*columns).repartition("a").sortWithinPartitions("a")
                    .mapInArrow(_sort_task(shape), "k1 long, k2 int, lo long, hi long"))
    crowd_windows = pieces.filter("crowded").select(*columns).mapInArrow(
        _count_task(shape), "h1 long, h2 long, k1 long, k2 int, lo long, alone boolean")
    shared = crowd_windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h1", "h2")
    crowd_spans = (crowd_windows.filter("alone").join(shared, ["h1", "h2"], "left_semi")
                   .select("k1", "k2", "lo", (F.col("lo") + window).alias("hi")))
    spans = spans_by_text(whole_spans(found, shape).unionByName(sorted_spans).unionByName(crowd_spans))
    schema = T.StructType([T.StructField(id_col, field(documents, id_col).dataType)] + [
        T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())])
    return docs.join(spans, ["k1", "k2"], "left").select("id", "text", "spans").mapInArrow(_remove(id_col), schema)
