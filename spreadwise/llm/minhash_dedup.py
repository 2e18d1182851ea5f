"""Operator 2: near-duplicate detection by DartMinHash.

A text is the weighted set of its shingles (``SHINGLE`` consecutive words, weight = how often). Each
shingle has its own endless field of darts over (weight, rank), thrown by hashing the shingle and a
cell of the field; a dart belongs to a text if it lies below the shingle's weight there. Two texts
share the darts of the region that they share. Each of ``COORDINATES`` coordinates takes the darts
that hash to it and keeps the earliest by rank; the chance that two texts keep the same dart is
their weighted Jaccard similarity. A text needs about t log t darts for t coordinates, however many
words it has, instead of t hashes a word.

Signatures are cut into bands of ``ROWS``; texts that agree in a band are candidates. At similarity
0.8 a pair shares none of the 40 bands with a chance of 1.3e-7. Candidates are checked exactly on
their shingles, and classes are the connected components of the links.

Hot groups. Equal texts are one node from the start. In a bucket of over ``CROWD`` nodes no pairs
are listed. There each node is first compared with the bucket's most central one, that with the least
weight that no other such node shares. What then lies in different components is joined exactly, by
prefixes: with the shingles of a node in one order for all, rarest first by a fixed table of hashed
counters (a bad count costs candidates, never a link), two nodes that reach the threshold share a shingle among the first (1 - threshold) of either's weight, early
enough to leave room for the overlap that they need. Pairs that share one, in different components,
are checked; no other pair can link two components. Near copies differ in rare shingles, so few
pairs remain: the join lists them by the links that are missing, not by the square of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, joined_components
from .frames import staged
from .text import MASK, Prefix, U, Words, as_signed, mix64, slices, utf8

SHINGLE = 5
COORDINATES, ROWS = 200, 5
CROWD = 24
COUNTERS = 1 << 20          # of the shingles of texts in large buckets; they decide an order only
SLACK = 4.0
_MAX_WIDTH = 256


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each shingle of a slice. A text of fewer words is one shingle."""
    data, offsets = utf8(column)
    words = Words(data, offsets)
    codes, bounds = words.hashes(), words.bounds
    p = Prefix(codes)
    size = np.diff(bounds)
    n = np.where(size >= SHINGLE, size - SHINGLE + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(size)), n)
    start = bounds[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    end = np.minimum(start + SHINGLE, bounds[1:][doc])
    return doc, mix64(p.of(start, end) ^ (end - start).astype(U))


def weighted(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) in text order, with the weight of each."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return doc[at], key[at], np.diff(np.concatenate([at, [len(doc)]]))


def _cells():
    """Widths of the rank cells: 1, 1, 2, 4, ... and then constant; each begins where the last ends."""
    lo, width = 0.0, 1.0
    while True:
        yield lo, width
        lo += width
        width = min(max(1.0, lo), _MAX_WIDTH)


def _poisson_table(mean: float) -> np.ndarray:
    top = int(mean + 12 * np.sqrt(mean) + 12)
    logs = np.arange(top) * np.log(mean) - mean - np.concatenate([[0], np.cumsum(np.log(np.arange(1, top)))])
    return np.cumsum(np.exp(logs))


_TABLES = {w: _poisson_table(w) for w in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0)}


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Dart kept at each coordinate of each of ``n`` texts, and which texts have a signature."""
    t = COORDINATES
    best = np.full(n * t, np.inf)
    dart = np.zeros(n * t, dtype=U)
    total = np.bincount(doc, weights=weight, minlength=n)
    with np.errstate(divide="ignore"):
        reach = np.where(total > 0, (t * np.log(t) + SLACK * t) / total, 0.0)
    # one unit of weight is one column of cells
    unit = np.repeat(np.arange(len(doc)), weight)
    level = np.arange(len(unit)) - np.repeat(np.cumsum(weight) - weight, weight)
    seed, owner = mix64(key[unit] ^ mix64(level.astype(U) + U(77))), doc[unit]
    for c, (lo, width) in enumerate(_cells()):
        empty = np.isinf(best).reshape(n, t).any(axis=1)
        live = (total > 0) & ((lo < reach) | empty)
        if not live.any():
            break
        at = np.flatnonzero(live[owner])
        cell = mix64(seed[at] + U(c * 0x9E3779B97F4A7C15 & MASK))
        count = np.searchsorted(_TABLES[width], (cell >> U(11)).astype(float) * 2.0 ** -53)
        each = np.repeat(np.arange(len(at)), count)
        number = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        name = mix64(cell[each] ^ mix64(number.astype(U) + U(1)))
        rank = lo + width * ((name >> U(11)).astype(float) * 2.0 ** -53)
        place = owner[at][each] * t + (mix64(name) % U(t)).astype(np.int64)
        before = best.copy()
        np.minimum.at(best, place, rank)
        won = (rank == best[place]) & (rank < before[place])
        dart[place[won]] = name[won]
    return dart.reshape(n, t), total > 0


def bands(sig: np.ndarray) -> np.ndarray:
    """One hash for each band of each signature."""
    n = len(sig)
    cut = sig.reshape(n, -1, ROWS)
    out = np.broadcast_to(mix64(np.arange(1, cut.shape[1] + 1, dtype=U)), cut.shape[:2]).copy()
    for r in range(ROWS):
        out = mix64(out * U(0x9E3779B97F4A7C15) + cut[:, :, r])
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            doc, key, weight = weighted(*shingles(part.column("text")))
            sig, known = signatures(doc, key, weight, part.num_rows)
            at = np.flatnonzero(known)
            total = np.bincount(doc, weights=weight, minlength=part.num_rows).astype(np.int64)
            flat = as_signed(bands(sig[at]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * (COORDINATES // ROWS)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(at)), pa.array(total[at]), lists], ["node", "size", "bands"])


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key % U(COUNTERS)).astype(np.int64)


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a task hold a shingle of each bucket."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            total += np.bincount(_bucket(weighted(*shingles(part.column("text")))[1]), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def _prefixes(holders, threshold: float):
    """The rarest shingles of each text, up to (1 - threshold) of its weight, and the weight of all that no
    other text has (as far as the counters tell). Texts that this weight keeps from any partner have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                doc, key, weight = weighted(*shingles(part.column("text")))
                often = holders.value[_bucket(key)]
                order = np.lexsort((key, often, doc))
                doc, key, weight, often = doc[order], key[order], weight[order], often[order]
                size = np.bincount(doc, weights=weight, minlength=part.num_rows)
                alone = np.bincount(doc, weights=weight * (often == 1), minlength=part.num_rows)
                upto = np.cumsum(weight) - weight
                before = upto - upto[np.searchsorted(doc, doc)]
                keep = (before <= size[doc] * (1 - threshold) + 1e-9) & (size - alone >= threshold * size)[doc]
                doc = doc[keep]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").take(pa.array(doc)), pa.array(as_signed(key[keep])), pa.array(before[keep].astype(np.int64)),
                     pa.array(size[doc].astype(np.int64)), pa.array(alone[doc].astype(np.int64))], ["node", "key", "before", "size", "alone"])
    return run


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    n = len(left)
    (da, ka), (db, kb) = shingles(left), shingles(right)
    doc, key, _ = weighted(np.concatenate([da, db]), np.concatenate([ka, kb]))

    def count(d, k):
        name = mix64(doc.astype(U) + U(1)) ^ key
        order = np.argsort(name)
        at = order[np.searchsorted(name, mix64(d.astype(U) + U(1)) ^ k, sorter=order)]
        return np.bincount(at, minlength=len(key))
    a, b = count(da, ka), count(db, kb)
    both, either = (np.bincount(doc, weights=f(a, b), minlength=n) for f in (np.minimum, np.maximum))
    return np.where(either > 0, both / np.maximum(either, 1), 0.0)


def _check(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_u", 1 << 19):
                ok = pa.array(similarity(part.column("text_u"), part.column("text_v")) >= threshold)
                yield part.select(["u", "v"]).filter(ok)
    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(u, v)`` whose texts reach the threshold, staged."""
    rows = (pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
            .join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v"))
    return staged(rows.select("u", "v", "text_u", "text_v").mapInArrow(_check(threshold), "u long, v long"), "verified")


def near_duplicate_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                           crowd: int = CROWD) -> DataFrame:
    """Class of every document: equal texts, and texts linked by a weighted Jaccard similarity of
    their five-word shingles of at least ``threshold``, directly or through others.

    Returns one row for each input row: the id, ``node`` (hash of the text), ``class_id`` (least id of
    the class), ``class_size`` (documents in it) and ``keep`` (true for one row of each class: the one
    with the least id). Only the id and text columns are read.

    Null, empty and white-space texts have no shingles: such a row is a class of its own, whatever
    its equals. Texts of fewer than five words are one shingle, their whole. Of repeated rows with the
    least id of their class, one is kept. Null ids come first. An empty table gives an empty result.
    """
    i, t = F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = documents.select(i.alias("id"), F.xxhash64(t).alias("node"), t.alias("text"))
    once = docs.groupBy("node").agg(F.first("text").alias("text"))       # combines map-side: a text copied often is a few rows
    nodes = staged(once.mapInArrow(_sketch, "node long, size long, bands array<long>"), "sketches")
    rows = nodes.select("node", "size", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    members = staged(rows.join(shared, "band"), "buckets")
    wanted = members.select("node").distinct()
    texts = staged(once.join(wanted, "node"), "candidates")

    few = members.filter(F.col("c") <= crowd).select("band", "node", "size")
    other = few.select("band", F.col("node").alias("v"), F.col("size").alias("size_v"))
    near = (F.col("size") >= F.col("size_v") * threshold) & (F.col("size_v") >= F.col("size") * threshold)
    pairs = few.withColumnRenamed("node", "u").join(other, "band").filter((F.col("u") < F.col("v")) & near).select("u", "v")

    crowded = members.filter(F.col("c") > crowd).select("band", "node", "size")
    in_crowds = texts.join(crowded.select("node").distinct(), "node", "left_semi").select("node", "text")
    counted = in_crowds.mapInArrow(_holders, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()     # <= COUNTERS rows
    holders = np.zeros(COUNTERS, np.uint32)
    holders[counted.column("bucket").to_numpy()] = np.minimum(counted.column("n").to_numpy(), (1 << 32) - 1)
    holders = documents.sparkSession.sparkContext.broadcast(holders)
    prefix = staged(in_crowds.mapInArrow(_prefixes(holders, threshold), "node long, key long, before long, size long, alone long"), "prefixes")
    able = prefix.groupBy("node").agg(F.first("alone").alias("alone"))
    central = crowded.join(able, "node")
    centre = central.groupBy("band").agg(F.min(F.struct("alone", "node")).alias("m"))
    spokes = (central.join(centre.select("band", F.col("m.node").alias("v")), "band").filter(F.col("node") != F.col("v"))
              .select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")))
    links = verified(pairs.union(spokes).distinct(), texts, threshold)
    named = components(links)

    # exact join of what is still apart; of two components that meet under a shingle, one is not its most frequent
    held = prefix.drop("alone").join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    most = (held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"))
    held = held.join(most.select("key", F.col("m.component").alias("usual")), "key")
    a, b = held.filter("component <> usual").alias("a"), held.alias("b")
    room = F.least(F.col("a.size") - F.col("a.before"), F.col("b.size") - F.col("b.before"))
    apart = ((F.col("a.component") != F.col("b.component"))
             & (room >= (F.col("a.size") + F.col("b.size")) * (threshold / (1 + threshold)) - 1e-9)
             & (F.col("a.size") >= F.col("b.size") * threshold) & (F.col("b.size") >= F.col("a.size") * threshold))
    rest = (a.join(b, (F.col("a.key") == F.col("b.key")) & apart)
            .select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct())
    more = verified(rest, texts, threshold)
    if not more.isEmpty():
        named = joined_components(named, more)

    # the row number makes one of several equal rows the least
    places = staged(docs.select("id", "node", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
                                F.monotonically_increasing_id().alias("row")), "places")
    by_node = places.filter("not blank").groupBy("node").agg(
        F.min(F.struct(F.col("id").isNotNull(), "id", "row")).alias("head"), F.count(F.lit(1)).alias("n"))
    by_node = by_node.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_class = by_node.groupBy("component").agg(F.min("head").alias("head"), F.sum("n").alias("class_size"))
    classes = by_node.select("node", "component").join(by_class, "component").select("node", "head", "class_size")
    blank = F.col("blank")
    return places.join(classes, "node", "left").select(
        F.col("id").alias(id_col), "node", F.when(blank, F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.when(blank, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        (blank | (F.col("row") == F.col("head.row"))).alias("keep"))


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``documents``, with all their columns, that ``near_duplicate_classes`` keeps: one
    of each class, and every row without words.

    Null, empty and white-space texts stay, each row of them; of repeated rows one stays; ties go to the least id, nulls
    first; an empty table gives an empty table; columns of any name pass through. A very long text is held whole
    by its task."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    heads = (near_duplicate_classes(documents, id_col, text_col, threshold).filter("keep")
             .select(F.col(id_col).alias("head_id"), F.col("node").alias("head_node")).distinct())
    rows = documents.filter(~blank).select(F.xxhash64(text).alias("head_node"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    same = F.col("l.head_node") == F.col("r.head_node")
    kept = rows.alias("l").join(heads.alias("r"), same & F.col("l.row").getField(id_col).eqNullSafe(F.col("r.head_id")))
    # of rows equal in id and text one stays
    kept = kept.groupBy(F.col("l.head_node"), F.col("r.head_id")).agg(F.first("l.row").alias("row")).select("row.*")
    return kept.unionByName(documents.filter(blank))
