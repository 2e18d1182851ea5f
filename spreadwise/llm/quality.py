"""Operator 9: quality rules combined by weak supervision.

Each rule looks at one property of a text and votes "good", "bad" or abstains. How far a rule can be
trusted is not set by hand: expectation-maximisation fits, for good and for bad texts, the
probability of each vote of each rule (rules independent given the class) and the share of good
texts. A text is kept if its posterior probability of being good reaches ``threshold``, instead
of having to pass every rule.

The fit needs only how often each pattern of votes occurs. There are at most 3 ** 10 = 59049
patterns, counted in Spark over all texts, which bounds what reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import field, staged
from .text import WHITE, Prefix, U, Words, mix64, separator_table, slices, span_hashes, utf8

SYMBOLS = separator_table(b"#*$%&|<>")
PLAIN = separator_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
LINE_END = separator_table(b".!?:;\"')")
_NEWLINE = 10
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_ended_lines", "n_distinct_words",
          "n_symbol_words", "n_plain_bytes", "n_word_bytes")


def _pairs(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One 64-bit key for each (text, key)."""
    return mix64(key ^ mix64(doc.astype(U) + U(1)))


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of each text of a slice, by the names in ``COUNTS``."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    words = Words(data, offsets, WHITE)
    per = lambda doc, w=None: np.bincount(doc, weights=w, minlength=n).astype(np.int64)

    def of_bytes(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(total[offsets])

    out = {"n_words": per(words.doc), "word_chars": per(words.doc, words.code_points()), "n_symbols": of_bytes(SYMBOLS[data])}
    lower, upper = (data >= 97) & (data <= 122), (data >= 65) & (data <= 90)
    out |= {"n_upper": of_bytes(upper), "n_letters": of_bytes(lower | upper)}
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    out["n_symbol_words"] = per(words.doc, symbols[words.ends] > symbols[words.starts])
    out |= {"n_plain_bytes": of_bytes(PLAIN[data]), "n_word_bytes": of_bytes(~WHITE[data])}
    hashes = words.hashes()
    out["n_distinct_words"] = per(words.doc[np.unique(_pairs(words.doc, hashes), return_index=True)[1]])
    # lines that hold a word: cut at every line feed and at every text's begin
    first_of_line = np.zeros(len(words), dtype=bool)
    if len(words):
        feeds = np.concatenate([[0], np.cumsum(data == _NEWLINE)])
        line_of = feeds[words.starts]
        first_of_line[0] = True
        first_of_line[1:] = (line_of[1:] != line_of[:-1]) | (words.doc[1:] != words.doc[:-1])
    at = np.flatnonzero(first_of_line)
    doc = words.doc[at]
    out["n_lines"] = per(doc)
    feed = np.flatnonzero(data == _NEWLINE)
    # a line runs from the feed (or text begin) before its first word to the next feed (or text end)
    i = np.searchsorted(feed, words.starts[at])
    lo = np.maximum(np.concatenate([[-1], feed])[i] + 1, offsets[doc])
    hi = np.minimum(np.concatenate([feed, [len(data)]])[i], offsets[doc + 1])
    lines = span_hashes(data, lo, hi)
    out["n_dup_lines"] = out["n_lines"] - per(doc[np.unique(_pairs(doc, lines), return_index=True)[1]])
    last = np.concatenate([at[1:], [len(words)]])[:len(at)] - 1
    out["n_ended_lines"] = per(doc, LINE_END[data[words.ends[last] - 1]] if len(at) else None)
    # three-word windows that occur at least twice in their text
    inside = np.flatnonzero(words.doc[2:] == words.doc[:-2]) if len(words) > 2 else np.zeros(0, np.int64)
    repeat = np.zeros(len(words), dtype=bool)
    if len(inside):
        key = _pairs(words.doc[inside], Prefix(hashes).windows(3)[inside])
        _, which, often = np.unique(key, return_inverse=True, return_counts=True)
        again = inside[often[which] > 1]
        for k in range(3):
            repeat[again + k] = True
    out["n_repeat_words"] = per(words.doc, repeat)
    return out


def _task(id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(found[c]) for c in COUNTS)], names=["id", *COUNTS])
    return run


def rule_votes() -> dict[str, F.Column]:
    """Votes by rule: 1 good, -1 bad, 0 abstain. Limits follow published filtering recipes."""
    c, words, lines = F.col, F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))

    def vote(bad, good):
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")

    mean, symbols = c("word_chars") / words, c("n_symbols") / words
    dup, repeat = c("n_dup_lines") / lines, c("n_repeat_words") / words
    upper, ended = c("n_upper") / F.greatest(c("n_letters"), F.lit(1)), c("n_ended_lines") / lines
    marked, plain = c("n_symbol_words") / words, c("n_plain_bytes") / F.greatest(c("n_word_bytes"), F.lit(1))
    distinct = c("n_distinct_words") / words
    return {
        "length": vote((c("n_words") < 50) | (c("n_words") > 100_000), c("n_words") >= 80),
        "word_length": vote((mean < 2.5) | (mean > 12), (mean >= 3) & (mean <= 10)),
        "symbols": vote(symbols > 0.1, symbols <= 0.02),
        "duplicate_lines": vote(dup > 0.3, dup <= 0.1),
        "repetition": vote(repeat > 0.3, repeat <= 0.1),
        "capitals": vote(upper > 0.4, upper <= 0.2),
        "line_ends": vote(ended < 0.1, ended >= 0.5),
        "symbol_words": vote(marked > 0.2, marked <= 0.05),
        "plain_bytes": vote(plain < 0.88, plain >= 0.94),
        "vocabulary": vote((c("n_words") >= 50) & (distinct < 0.15), distinct >= 0.3),
    }


def fit_votes(patterns: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """EM over patterns of votes: share of good texts, and log P(vote | class) by [class, rule, vote + 1]."""
    rules = patterns.shape[1]
    onehot = patterns[:, :, None] == np.array([-1, 0, 1])
    balance = patterns.sum(axis=1)
    good = np.clip(0.5 + 0.4 * balance / max(rules, 1), 0.05, 0.95)
    # pseudo-counts say, weakly, that a vote is right more often than wrong
    prior = np.array([[[3.0, 1.0, 1.0]], [[1.0, 1.0, 3.0]]])
    for _ in range(rounds):
        share = (1 + (weight * good).sum()) / (2 + weight.sum())
        soft = np.stack([(1 - good) * weight, good * weight])
        table = np.einsum("cp,prv->crv", soft, onehot) + prior
        logs = np.log(table / table.sum(axis=2, keepdims=True))
        new = posterior(patterns, share, logs)
        done = np.abs(new - good).max(initial=0) < 1e-10
        good = new
        if done:
            break
    return share, logs


def posterior(patterns: np.ndarray, share: float, logs: np.ndarray) -> np.ndarray:
    rule = np.arange(patterns.shape[1])
    bad, good = (logs[c][rule, patterns + 1].sum(axis=1) for c in (0, 1))
    return 1 / (1 + np.exp(np.clip(bad + np.log(1 - share) - good - np.log(share), -700, 700)))


def judge_quality(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Measure every whole text, let the rules vote, and combine the votes.

    Returns the id, the counts of ``COUNTS``, ``votes`` (array in the order of ``rule_votes``),
    ``p_good`` and ``kept``. Words are runs of anything but ASCII white space.

    Null and empty texts have zero counts and are judged by the same rules (their votes are mostly
    "bad" or abstentions); repeated rows get equal verdicts and each counts in the fit; other columns
    are not read; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    id_type = field(documents, id_col).dataType
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    measured = rows.mapInArrow(_task(id_col), T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in COUNTS)]))
    rules = rule_votes()
    voted = staged(measured.select("id", *COUNTS, F.array(*rules.values()).alias("votes")), "votes")
    found = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    patterns = np.array([r.votes for r in found], dtype=np.int64).reshape(-1, len(rules))
    share, logs = fit_votes(patterns, np.array([r.n for r in found], dtype=float))
    weight = logs[1] - logs[0]                       # log likelihood ratio of each vote
    score = F.lit(float(np.log(share) - np.log(1 - share)))
    for r in range(len(rules)):
        v = F.col("votes")[r]
        score = score + F.when(v == -1, float(weight[r, 0])).when(v == 0, float(weight[r, 1])).otherwise(float(weight[r, 2]))
    p = 1 / (1 + F.exp(-score))
    return voted.select(F.col("id").alias(id_col), *COUNTS, "votes", p.alias("p_good")).withColumn("kept", F.col("p_good") >= threshold)
