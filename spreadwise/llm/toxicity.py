"""Operator 7: toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased words, each a 64-bit hash. The score is the logistic function of
a bias, a weight for each term, and, for each pair of terms, the dot product of their factor
vectors, so that a pair such as an insult with a mention of a group can count for more than the sum
of its words. The pair sum costs O(terms) by the square-of-sums identity.

The machine is fitted on a bounded sample: the ``sample_rows`` labelled rows with the smallest hash
of their id. Terms seen in fewer than ``MIN_TEXTS`` of them are left out, so the model is bounded
as well; so are infrequent terms that a likelihood-ratio test finds independent of the label, which with
hundreds of chance words a text would let any sample be learned by heart. Weights follow the regularised leader (L1 keeps chance words at exactly zero), factors an
adaptive gradient.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import field
from .language_id import Table
from .superkmers import ragged
from .text import NOT_ALNUM, U, Words, as_signed, lower_ascii, mix64, slices, utf8

MIN_TEXTS = 3
FREQUENT_SHARE = 0.02       # terms in this share of the sample are always kept, for their pairs
LEAST_GAIN = 10.83          # else the likelihood ratio of term and label must reach this (p = 0.001)


def text_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every word of a slice, in order."""
    data, offsets = utf8(column)
    words = Words(lower_ascii(data), offsets, NOT_ALNUM)
    return words.doc, words.hashes()


def distinct(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, term) once, by text."""
    first = np.unique(mix64(term ^ mix64(doc.astype(U) + U(1))), return_index=True)[1]
    first.sort()
    return doc[first], term[first]


class Machine:
    """Factorization machine over a fixed set of terms, with binary features."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, factor: np.ndarray, bias: float):
        self.terms, self.weight, self.factor, self.bias = Table(terms), weight, factor, bias

    def margin(self, doc: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Score before the logistic function; ``row``: known terms of the texts ``doc``."""
        linear = np.bincount(doc, weights=self.weight[row], minlength=n)
        pairs = np.zeros(n)
        for f in range(self.factor.shape[1]):
            v = self.factor[row, f]
            pairs += np.bincount(doc, weights=v, minlength=n) ** 2 - np.bincount(doc, weights=v * v, minlength=n)
        return self.bias + linear + pairs / 2

    def score(self, column: pa.Array) -> np.ndarray:
        doc, term = text_terms(column)
        row = self.terms.find(term)
        known = row >= 0
        doc, row = doc[known], row[known]
        key = np.unique(doc * np.int64(len(self.weight) + 1) + row)
        doc, row = key // (len(self.weight) + 1), key % (len(self.weight) + 1)
        return logistic(self.margin(doc, row, len(column)))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def likelihood_ratio(both: np.ndarray, often: np.ndarray, positive: float, n: int) -> np.ndarray:
    """G statistic of each term's 2 x 2 table with the label."""
    total = np.zeros(len(often))
    for seen, row, column in ((both, often, positive), (often - both, often, n - positive),
                              (positive - both, n - often, positive), (n - often - positive + both, n - often, n - positive)):
        with np.errstate(divide="ignore", invalid="ignore"):
            total += np.where(seen > 0, 2 * seen * np.log(seen * n / (row * column)), 0)
    return total


def fit(doc: np.ndarray, term: np.ndarray, label: np.ndarray, factors: int = 4, epochs: int = 16, batch: int = 64,
        rate: float = 1.0, l1: float = 8.0, l2: float = 1e-3, factor_rate: float = 0.005, positive_weight: float = 3.0,
        seed: int = 7) -> Machine:
    """Fit on (text, term) pairs sorted by text, one label for each text. ``positive_weight`` is how
    many times worse a missed toxic text is than a clean one that is marked."""
    n = len(label)
    names, row, often = np.unique(term, return_inverse=True, return_counts=True)
    keep = often >= MIN_TEXTS
    if n and len(names):
        gain = likelihood_ratio(np.bincount(row, weights=label[doc], minlength=len(names)), often, label.sum(), n)
        keep &= (gain >= LEAST_GAIN) | (often >= FREQUENT_SHARE * n)
    number = np.cumsum(keep) - 1
    doc, row, names = doc[keep[row]], number[row[keep[row]]], names[keep]
    share = (label.sum() + 1) / (n + 2) if n else 0.25         # without any label nothing is marked
    bias = float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    factor = rng.normal(0, 0.01, (len(names), factors))
    model = Machine(names, np.zeros(len(names)), factor, bias)
    if not n or not len(names) or label.min() == label.max():
        model.factor[:] = 0
        return model
    z, g2, v2 = np.zeros(len(names)), np.zeros(len(names)), np.full(factor.shape, 1e-2)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    b2 = 1.0
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            texts = order[lo:lo + batch]
            size = bounds[texts + 1] - bounds[texts]
            d = np.repeat(np.arange(len(texts)), size)
            r = row[np.repeat(bounds[texts] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            error = logistic(model.margin(d, r, len(texts))) - label[texts]
            error *= np.where(label[texts] > 0, positive_weight, 1.0)
            b2 += float((error ** 2).sum())
            model.bias -= 0.1 * float(error.sum()) / np.sqrt(b2)
            used, at = np.unique(r, return_inverse=True)
            e = error[d]
            g = np.bincount(at, weights=e)
            was = np.sqrt(g2[used])
            g2[used] += g * g
            z[used] += g - (np.sqrt(g2[used]) - was) / rate * model.weight[used]
            model.weight[used] = np.where(np.abs(z[used]) <= l1, 0.0, -(z[used] - np.sign(z[used]) * l1) / ((1 + np.sqrt(g2[used])) / rate + l2))
            for f in range(factors):
                v = model.factor[:, f]
                total = np.bincount(d, weights=v[r], minlength=len(texts))
                g = np.bincount(at, weights=e * (total[d] - v[r])) + l2 * v[used]
                v2[used, f] += g * g
                v[used] -= factor_rate * g / np.sqrt(v2[used, f])
    return model


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            doc, term = distinct(*text_terms(part.column("text")))
            cut = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.ListArray.from_arrays(pa.array(cut), pa.array(as_signed(term)))],
                                             ["id", "label", "terms"])


def _score(model, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.value.score(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                                 names=[id_name, "held_out", "score", "predicted"])
    return run


def train(documents: DataFrame, labels: DataFrame, sample_rows: int) -> Machine:
    """Fit on ``documents(id, text)`` and ``labels(id, label)``; rows without a label are left out."""
    sample = (labels.filter("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(sample_rows))
    # the sample has at most sample_rows rows; an id that repeats in the documents counts once
    found = (documents.join(F.broadcast(sample), "id").select("id", "label", "text")
             .mapInArrow(_terms, T.StructType([field(documents.select("id"), "id"), T.StructField("label", T.IntegerType()), T.StructField("terms", T.ArrayType(T.LongType()))]))
             .groupBy("id").agg(F.max(F.struct("label", "terms")).alias("r")).select("id", "r.*").toArrow())
    order = np.argsort([str(x) for x in found.column("id").to_pylist()], kind="stable")
    found = found.take(pa.array(order)).combine_chunks()
    terms, cut = ragged(found.column("terms")) if found.num_rows else (pa.array([], pa.int64()), np.zeros(1, np.int64))
    doc = np.repeat(np.arange(found.num_rows), np.diff(cut))
    return fit(doc, np.asarray(terms).astype(np.int64).view(U), found.column("label").to_numpy().astype(float))


def _keep_clean(model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(model.value.score(part.column(text_col)) < 0.5))
    return run


def _fitted(documents: DataFrame, labels: DataFrame, held_out: Column, id_col: str, text_col: str, label_col: str, sample_rows: int):
    """The machine, fitted on rows that are not held out, as a broadcast variable."""
    rows = documents.filter(~held_out).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = labels.filter(~held_out).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    return documents.sparkSession.sparkContext.broadcast(train(rows, marked, sample_rows))


def score_toxicity(documents: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", sample_rows: int = 10_000) -> DataFrame:
    """Score every whole text between 0 and 1; learn from labelled rows that are not ``held_out``.

    ``held_out`` is an expression over the id column. Returns the id, ``held_out``, ``score`` and
    ``predicted`` (1 if the score is at least 0.5). Only the text enters a score.

    Null and empty texts get the score of no terms at all; rows with a null label are not learned
    from; a repeated id with several labels counts as toxic if one says so; without labels, or with
    labels of one kind only, every text gets the smoothed share of toxic labels; repeated rows are
    scored alike; other columns are not read; an empty table gives an empty result.
    """
    model = _fitted(documents, labels, held_out, id_col, text_col, label_col, sample_rows)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    schema = T.StructType([T.StructField(id_col, field(documents, id_col).dataType), T.StructField("held_out", T.BooleanType()),
                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(_score(model, id_col), schema)


def reject_toxic(documents: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", sample_rows: int = 10_000) -> DataFrame:
    """The rows of ``documents``, with all their columns, that ``score_toxicity`` does not mark.

    Null and empty texts are texts without words, repeated rows stay or go together, columns of any name pass
    through, an empty table gives an empty table, and without a label to learn from every row stays. A very
    long text is held whole by its task.
    """
    model = _fitted(documents, labels, held_out, id_col, text_col, label_col, sample_rows)
    return documents.mapInArrow(_keep_clean(model, text_col), documents.schema)
