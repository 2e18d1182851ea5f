"""Operator 6: language-model scoring by prediction by partial matching, with word base scores.

The model is a byte-context trie of orders 0 to 4 with the counts of all training texts. A byte is
predicted in its longest context; an unseen byte escapes (method C) to the context one byte
shorter, where the bytes seen in the longer one are excluded, and at last to a uniform byte. A text
begins after four start symbols and ends with an end symbol. Counts are frozen before scoring.

Neither the trie nor the word counts are bounded, so neither is broadcast. Texts go to groups of
about ``group_bytes`` by a hash of their row. Each group asks for its distinct 5-byte grams and
words, with how often it has them in training texts. A shard owns all grams whose context ends in certain three
bytes (so it holds complete statistics of orders 4 and 3) and all words of certain hashes, adds up the
training counts, and answers. Each group is then scored from its answers. Only the statistics of
orders 0 to 2 are broadcast: three bytes, at most 2^24 counts.

Requests climb a tree. A group sends one message to each of ``SHARDS`` shards; ``FAN`` groups' messages to a
shard are merged into one, whose grams are distinct again, and split among ``SPLIT`` times as many shards,
until at most ``FAN`` senders are left; answers come down the same way. So there are groups x SHARDS messages,
not groups x shards, and what a shard is asked is bounded by its distinct grams and words, however many groups hold
a common one: a passage that a third of all texts share costs one entry a group on the way and FAN at the shard.
Words are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import field, staged
from .language_id import padded
from .text import U, WHITE, Words, lower_ascii, mix64, slices, utf8

ORDER = 4
START, END = 0xFE, 0xFF          # bytes that UTF-8 never holds
SYMBOLS = 256                    # the end symbol among them
DENSE = 1 << 26
END_WORD = U(0xFFFFFFFFFFFFFFFF)
GRAMS, WORDS = 0, 1
SHARDS, FAN, SPLIT = 16, 32, 8
_MESSAGE = "shard int, g long, kind int, keys binary, counts binary"
_ANSWER = "shard int, g long, kind int, keys binary, found binary, total long, kinds long"


def with_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text between ``ORDER`` start symbols and an end symbol; where each begins."""
    ext, start = padded(data, offsets, ORDER + 1, START)
    shifted = np.empty_like(ext)                 # padding stands in front: move its last byte to the end
    shifted[:-1], shifted[-1:] = ext[1:], START
    ends = start[1:] - 1
    shifted[ends] = END
    return shifted, start


def distinct_grams(symbols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of ``size`` symbols as integers, and which one starts at each place.

    Grams are numbered through their prefixes in dense tables instead of sorted.
    """
    present = np.flatnonzero(np.bincount(symbols, minlength=256))
    code = np.zeros(256, dtype=np.int64)
    code[present] = np.arange(len(present))
    code = code[symbols]
    keys, own = present.astype(U), code
    for k in range(1, size):
        both = own[:len(code) - k] * len(present) + code[k:]
        space = len(keys) * len(present)
        if space <= DENSE:
            mark = np.zeros(space, dtype=bool)
            mark[both] = True
            found = np.flatnonzero(mark)
            number = np.cumsum(mark, dtype=np.int32) - 1
            own = number[both].astype(np.int64)
        else:
            found, own = np.unique(both, return_inverse=True)
        keys = keys[found // len(present)] << U(8) | present[found % len(present)].astype(U)
    return keys, own


def gram_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(keys >> U(8) & U(0xFFFFFF)) % U(shards)).astype(np.int64)


def word_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(keys) % U(shards)).astype(np.int64)


class Group:
    """Distinct grams and words of a group of texts, the same in every evaluation."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        self.n = len(offsets) - 1
        self.symbols, self.start = with_ends(data, offsets)
        self.keys, self.at = distinct_grams(self.symbols, ORDER + 1)
        crossing = np.zeros(len(self.keys), dtype=bool)
        for b in range(1, ORDER + 1):
            crossing |= (self.keys >> U(8 * b)) & U(0xFF) == U(END)
        self.valid = ~crossing
        words = Words(lower_ascii(data), offsets, WHITE)
        text = np.concatenate([words.doc, np.arange(self.n)])
        self.words, self.word_at = np.unique(np.concatenate([words.hashes(), np.full(self.n, END_WORD)]), return_inverse=True)
        self.word_text = text

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the grams and of the words."""
        text = np.repeat(np.arange(self.n), np.diff(self.start))[:len(self.at)]
        return (np.bincount(self.at[train[text]], minlength=len(self.keys)),
                np.bincount(self.word_at[train[self.word_text]], minlength=len(self.words)))


def _low_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three-symbol grams of the training texts, counted once a task."""
    total: dict[int, int] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            symbols, _ = with_ends(*utf8(part.column("text")))
            keys, at = distinct_grams(symbols[ORDER - 2:], 3)
            inside = ((keys >> U(8)) & U(0xFF) != U(END)) & (keys >> U(16) != U(END)) & (keys & U(0xFF) != U(START))
            n = np.bincount(at, minlength=len(keys))
            for k, c in zip(keys[inside].tolist(), n[inside].tolist(), strict=True):
                total[k] = total.get(k, 0) + c
    yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])


class Low:
    """Complete statistics of orders 2, 1 and 0: counts of grams, and totals, kinds and the count
    of excluded bytes of each context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.levels = {}
        keys, n = keys[order].astype(U), counts[order].astype(float)
        for d in (2, 1, 0):
            if d < 2:
                keys, row = np.unique(keys & U((1 << (8 * (d + 1))) - 1), return_inverse=True)
                n = np.bincount(row, weights=n, minlength=len(keys))
            self.levels[d] = [keys, n]
        for d in (2, 1, 0):
            keys, n = self.levels[d]
            ctx, row = np.unique(keys >> U(8), return_inverse=True)
            below = self.count(d - 1, keys & U((1 << (8 * d)) - 1)) if d else np.zeros(len(keys))
            self.levels[d] += [ctx, np.bincount(row, weights=n, minlength=len(ctx)),
                               np.bincount(row, minlength=len(ctx)).astype(float), np.bincount(row, weights=below, minlength=len(ctx))]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def count(self, d: int, grams: np.ndarray) -> np.ndarray:
        at, ok = self._find(self.levels[d][0], grams)
        return np.where(ok, self.levels[d][1][at] if len(self.levels[d][1]) else 0.0, 0.0)

    def context(self, d: int, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, total, kinds, below = self.levels[d][2:]
        at, ok = self._find(keys, ctx)
        return tuple(np.where(ok, x[at] if len(x) else 0.0, 0.0) for x in (total, kinds, below))


def log_probabilities(keys: np.ndarray, n4: np.ndarray, low: Low) -> np.ndarray:
    """log10 probability of the last symbol of each gram in its context.

    ``keys`` are distinct sorted grams of five symbols with their training counts, and must hold all
    trained grams that share the last three context symbols of any of them.
    """
    n4 = n4.astype(float)
    k3 = keys & U(0xFFFFFFFF)
    u3, r3 = np.unique(k3, return_inverse=True)
    sum3 = np.bincount(r3, weights=n4, minlength=len(u3))
    n3 = sum3[r3]
    _, c4 = np.unique(keys >> U(8), return_inverse=True)
    seen = n4 > 0
    total4, kinds4 = np.bincount(c4, weights=n4), np.bincount(c4, weights=seen)
    below4 = np.bincount(c4, weights=np.where(seen, n3, 0))
    _, c3 = np.unique(u3 >> U(8), return_inverse=True)
    seen3 = sum3 > 0
    n2_of_u3 = low.count(2, u3 & U(0xFFFFFF))
    stats3 = [np.bincount(c3, weights=w)[c3][r3] for w in (sum3, seen3, np.where(seen3, n2_of_u3, 0))]
    levels = [(n4, total4[c4], kinds4[c4], below4[c4]), (n3, *stats3)]
    for d in (2, 1, 0):
        gram = keys & U((1 << (8 * (d + 1))) - 1)
        levels.append((low.count(d, gram), *low.context(d, gram >> U(8))))
    out = np.zeros(len(keys))
    todo = np.ones(len(keys), dtype=bool)
    gone_n, gone_q = np.zeros(len(keys)), np.zeros(len(keys))     # excluded count and kinds
    with np.errstate(divide="ignore", invalid="ignore"):
        for n, total, kinds, below in levels:
            mass = total - gone_n + kinds - gone_q
            here = todo & (n > 0)
            out[here] += np.log10(n[here] / mass[here])
            todo &= ~here
            away = todo & (mass > 0) & (total > 0)
            out[away] += np.log10((kinds - gone_q)[away] / mass[away])
            met = total > 0
            gone_n, gone_q = np.where(met, below, gone_n), np.where(met, kinds, gone_q)
    out[todo] -= np.log10(SYMBOLS - gone_q[todo])
    return out


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys by their steps, which compress."""
    return np.diff(keys, prepend=U(0)).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, U), dtype=U)


def _pack_counts(n: np.ndarray) -> bytes:
    return n.astype(np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64).tobytes()


def _unpack_counts(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if len(raw) == 4 * size else np.uint64)


_SHARD_OF = {GRAMS: gram_shard, WORDS: word_shard}


def _messages(g: int, asked: dict[int, tuple[np.ndarray, np.ndarray]], shards: int) -> list[tuple]:
    """Sorted keys and counts by kind, one message to each shard that owns any."""
    rows = []
    for kind, (keys, n) in asked.items():
        own = _SHARD_OF[kind](keys, shards)
        order = np.argsort(own, kind="stable")
        cut = np.searchsorted(own[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            at = order[cut[s]:cut[s + 1]]
            rows.append((int(s), g, kind, pack(keys[at]), _pack_counts(n[at])))
    return rows


def _table(rows: list[tuple], names: tuple[str, ...], types: tuple) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _message_table(rows: list[tuple]) -> pa.Table:
    return _table(rows, ("shard", "g", "kind", "keys", "counts"), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))


def _ask(shards: int):
    """The texts of a group to its messages."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = Group(table.column("text"))
        grams, words = group.counts(~table.column("held_out").to_numpy().astype(bool))
        asked = {GRAMS: (group.keys[group.valid], grams[group.valid]), WORDS: (group.words, words)}
        return _message_table(_messages(int(key[0].as_py()), asked, shards))
    return run


def _merged(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct keys of some messages, by kind, with their counts added up."""
    out = {}
    kinds = table.column("kind").to_numpy()
    for kind in np.unique(kinds).tolist():
        part = table.filter(pa.array(kinds == kind))
        asked = [unpack(k) for k in part.column("keys").to_pylist()]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        n = np.concatenate([_unpack_counts(c, len(k)) for c, k in zip(part.column("counts").to_pylist(), asked, strict=True)])
        out[kind] = keys, np.bincount(at, weights=n, minlength=len(keys))
    return out


def _climb(shards: int):
    """Messages of one shard and one set of senders to those of one sender to finer shards."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _message_table(_messages(int(key[1].as_py()), _merged(table), shards))
    return run


def _answer_table(rows: list[tuple]) -> pa.Table:
    return _table(rows, ("shard", "g", "kind", "keys", "found", "total", "kinds"),
                  (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))


def _values(kind: int, value: np.ndarray) -> bytes:
    return value.astype(np.float32 if kind == GRAMS else np.float64).tobytes()


def _read_values(kind: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if kind == GRAMS else np.float64).astype(float)


def _answer(low):
    """All messages to a shard to their answers; a shard's totals stand once for each kind."""
    def run(table: pa.Table) -> pa.Table:
        values = {}
        for kind, (keys, n) in _merged(table).items():
            values[kind] = (keys, log_probabilities(keys, n, low.value), 0, 0) if kind == GRAMS else (keys, n, int(n.sum()), int((n > 0).sum()))
        out, told = [], set()
        for shard, g, kind, raw in zip(*(table.column(c).to_pylist() for c in ("shard", "g", "kind", "keys")), strict=True):
            keys, value, total, kinds = values[kind]
            out.append((shard, g, kind, raw, _values(kind, value[np.searchsorted(keys, unpack(raw))]), *((0, 0) if kind in told else (total, kinds))))
            told.add(kind)
        return _answer_table(out)
    return run


def _descend(messages: pa.Table, answers: pa.Table) -> pa.Table:
    """Answers to a merged message to those of the messages that it was made of."""
    known, out = {}, []
    kinds = answers.column("kind").to_numpy()
    for kind in np.unique(kinds).tolist():
        part = answers.filter(pa.array(kinds == kind))
        keys = np.concatenate([unpack(k) for k in part.column("keys").to_pylist()])
        order = np.argsort(keys)
        known[kind] = keys[order], np.concatenate([_read_values(kind, v) for v in part.column("found").to_pylist()])[order]
    for shard, g, kind, raw in zip(*(messages.column(c).to_pylist() for c in ("shard", "g", "kind", "keys")), strict=True):
        keys, value = known[kind]
        out.append((shard, g, kind, raw, _values(kind, value[np.searchsorted(keys, unpack(raw))]), 0, 0))
    return _answer_table(out)


def _score(texts: pa.Table, answers: pa.Table) -> pa.Table:
    group = Group(texts.column("text"))
    grams, words = np.zeros(len(group.keys)), np.zeros(len(group.words))
    for kind, keys, found in zip(*(answers.column(c).to_pylist() for c in ("kind", "keys", "found")), strict=True):
        own, into = (group.keys, grams) if kind == GRAMS else (group.words, words)
        into[np.searchsorted(own, unpack(keys))] = _read_values(kind, found)
    bits = np.concatenate([grams[group.at], np.zeros(ORDER)])
    score = np.add.reduceat(bits, group.start[:-1])
    n = words[group.word_at]
    per = lambda w=None: np.bincount(group.word_text, weights=w, minlength=group.n)
    return pa.table([texts.column("id"), texts.column("held_out"), pa.array(per().astype(np.int64)), pa.array(per(n > 0).astype(np.int64)),
                     pa.array(per(np.log10(n + 1))), pa.array(score)], names=["id", "held_out", "n_tokens", "n_known", "log_counts", "score"])


def _asked_and_answered(texts: DataFrame, groups: int, low) -> tuple[DataFrame, DataFrame]:
    """Answers to every group's messages, and one row a shard with its totals."""
    up = [staged(texts.groupBy("g").applyInArrow(_ask(SHARDS), _MESSAGE), "asked")]
    senders, shards = groups, [SHARDS]
    while senders > FAN:
        shards.append(shards[-1] * SPLIT)
        merged = up[-1].groupBy("shard", F.floor(F.col("g") / FAN).alias("to")).applyInArrow(_climb(shards[-1]), _MESSAGE)
        up.append(staged(merged, "asked"))
        senders = -(-senders // FAN)
    down = staged(up[-1].groupBy("shard").applyInArrow(_answer(low), _ANSWER), "answers")
    totals = down.groupBy().agg(F.coalesce(F.sum("total"), F.lit(0)).alias("train_tokens"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("kinds"))
    for level in range(len(up) - 2, -1, -1):
        mine = up[level].select("shard", "g", "kind", "keys").withColumn("to", F.floor(F.col("g") / FAN))
        above = down.select(F.pmod("shard", F.lit(shards[level])).cast("int").alias("shard"), F.col("g").alias("to"), "kind", "keys", "found")
        answered = mine.groupBy("shard", "to").cogroup(above.groupBy("shard", "to")).applyInArrow(_descend, _ANSWER)
        down = staged(answered, "answers") if level else answered
    return down, totals


def score_texts(documents: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                group_bytes: int = 8_000_000) -> DataFrame:
    """Score every whole text; learn from the rows that are not ``held_out``.

    Returns the id, ``held_out``, ``n_tokens`` (words, with A-Z lower-cased, and one end),
    ``n_known`` (tokens seen in training), ``train_tokens``, ``base_score`` (log10 of the add-one word
    probabilities) and ``score`` (log10 probability of the text's bytes and its end under the trie).

    Null text is empty and is scored as its end alone; without training rows every byte is uniform
    and the base uses zero counts; repeated rows are scored alike (and each counts in training);
    other columns are not read; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                            F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    groups = max(1, round(size / group_bytes))
    three = (rows.filter("not held_out").select("text").mapInArrow(_low_counts, "gram long, n long")
             .groupBy("gram").agg(F.sum("n").alias("n")).toArrow())
    low = spark.sparkContext.broadcast(Low(three.column("gram").to_numpy(), three.column("n").to_numpy()))
    texts = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(groups)).alias("g"), "id", "text", "held_out")
    id_type = field(documents, id_col).dataType
    answers, totals = _asked_and_answered(texts, groups, low)
    scored = texts.groupBy("g").cogroup(answers.select("g", "kind", "keys", "found").groupBy("g")).applyInArrow(_score, T.StructType([
        T.StructField("id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("log_counts", T.DoubleType()), T.StructField("score", T.DoubleType())]))
    # totals is one row
    return scored.crossJoin(F.broadcast(totals)).select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens",
        (F.col("log_counts") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.col("kinds") + 1)).alias("base_score"), "score")
