"""Operator 12: personal data by a skip-chain conditional random field.

Patterns find the plain cases (``base_spans``). The field then judges every other word that holds a digit
or an at sign. Its nodes are the base spans, whose kinds are known, and these words; neighbouring
words are linked as in a linear chain, and distant nodes of a document are linked where they repeat or
resemble each other: equal digits, equal last seven digits, equal word or e-mail name. Linked nodes share a
potential, so what one mention is known to be is a reason for the others, however they are written: a
phone number without its plus, a card number with dots. Loopy message passing over the document gives
each word its probability of each kind; words that reach ``threshold`` are added as spans.

Weights are learned here. Base spans label a bounded sample of texts (``SAMPLE_TEXTS`` for each kind and as many
without any, of at most ``SAMPLE_CHARS``, the smallest hashes of their texts). Each base span of the sample is
also mentioned again in another spelling, labelled as the same kind, and beside it stands the same
spelling of random digits, labelled as nothing: the spelling alone is no evidence, its links are. Node,
chain and link weights are fitted together by pseudo-likelihood.

Links join one occurrence with the next of the same kind of likeness, so they grow with the text and
never with the square of a repeated word. Texts are read whole, twice, and never shuffled.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import field
from .text import WHITE, Words, separator_table, slices, utf8

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
N = len(LABELS)
WIDTH = 1 << 14
SAMPLE_TEXTS, SAMPLE_CHARS = 300, 10_000
LINKS = ("digits", "ending", "name")      # kinds of likeness; the chain comes after them
CHAIN = len(LINKS)

# Runs are taken whole (possessive), so no text makes a scan quadratic; what they match is unchanged
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_OR_AT = separator_table(b"0123456789@")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is the run of its characters before an at sign with a domain, back to the last match."""
    done = 0
    for m in _AT.finditer(text):
        lo = m.start()
        while lo > done and text[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        if lo < m.start():
            yield lo, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` in code points, by kind, then start."""
    found = [(0, lo, hi) for lo, hi in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            found.append((3, m.start(), m.end()))
    return found


_EDGE = re.compile(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$")
_SPLIT_NAME = re.compile(r"@|\[at\]|\(at\)")


def shape(text: str) -> str:
    """Runs of letters and of digits as one sign each, digits with their number."""
    return re.sub(r"[0-9]+", lambda m: f"<{min(len(m[0]), 20)}>", re.sub(r"[^\x00-\x7F]+", "n", re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", text[:64]))))


def features(text: str, before: str | None, after: str | None, alone: bool) -> list[int]:
    """Numbers of a node's features. ``before`` and ``after``: the plain words beside it, if they are plain."""
    core, digits = _EDGE.sub("", text), only_digits(text)
    n = len(digits)
    parts = core.split(".")
    found = ["", "s=" + shape(text), "c=" + shape(core), f"n={n if n < 4 else 4 if n < 7 else 7 if n < 9 else 9 if n < 13 else 13 if n < 20 else 20}",
             f"@={text.count('@')}", f"+={text[:1] == '+'}", f"alone={alone}", f"b={(before or '').lower()[-16:]}", f"a={(after or '').lower()[:16]}"]
    if 13 <= n <= 19:
        found.append(f"luhn={luhn(digits)}")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        found.append(f"ip={all(len(p) <= 3 and int(p) <= 255 for p in parts)}")
    return [zlib.crc32(f.encode()) % WIDTH for f in found]


def likeness(text: str) -> list[tuple[int, str]]:
    """``(link, key)``: nodes of a document with an equal pair are linked."""
    digits = only_digits(text)
    name = _EDGE.sub("", _SPLIT_NAME.split(text)[0]).lower()
    found = [(0, digits)] if len(digits) >= 5 else []
    if 7 <= len(digits) <= 15:
        found.append((1, digits[-7:]))
    return [*found, (2, name)] if len(name) >= 5 and not name.isdigit() else found


class Graph:
    """Nodes and links of some documents: text and place of each node, its features and known kind."""

    def __init__(self):
        self.doc: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.known: list[int] = []           # label of a base span, -1 for a word
        self.rows: list[int] = []
        self.cols: list[int] = []
        self.links: list[tuple[int, int, int]] = []

    def __len__(self) -> int:
        return len(self.doc)

    def add(self, doc: int, text: str, words: list[tuple[int, int]], neighbours: list[tuple[str | None, str | None]], base: list[tuple[int, int, int]]) -> None:
        """Nodes of one document. ``words``: spans of the words with a digit or at sign, ``neighbours`` the
        words beside each; ``base``: its base spans."""
        spans: list[tuple[int, int, int]] = []
        for kind, lo, hi in sorted(base, key=lambda s: (s[1], s[0])):
            if not spans or lo >= spans[-1][1]:
                spans.append((lo, hi, kind + 1))
            else:                               # overlapping kinds are one node of the first kind that begins there
                spans[-1] = (spans[-1][0], max(hi, spans[-1][1]), spans[-1][2])
        nodes, at = [], 0
        beside = {}
        for (lo, hi), pair in zip(words, neighbours, strict=True):
            while at < len(spans) and spans[at][1] <= lo:
                at += 1
            if at < len(spans) and spans[at][0] < hi:
                beside.setdefault(at, [pair[0], pair[1]])[1] = pair[1]
            else:
                nodes.append((lo, hi, -1, pair))
        nodes += [(lo, hi, kind, tuple(beside.get(i, (None, None)))) for i, (lo, hi, kind) in enumerate(spans)]
        nodes.sort(key=lambda x: x[0])
        last: dict[tuple[int, str], int] = {}
        for i, (lo, hi, kind, (before, after)) in enumerate(nodes):
            number = len(self.doc)
            mine = text[lo:hi]
            near = i > 0 and (gap := text[nodes[i - 1][1]:lo]) != "" and len(gap) <= 8 and not gap.strip(" \t\n\r\v\f.,;:!?()[]\"'")
            follows = i + 1 < len(nodes) and len(gap := text[hi:nodes[i + 1][0]]) <= 8 and not gap.strip(" \t\n\r\v\f.,;:!?()[]\"'")
            if near:
                self.links.append((number - 1, number, CHAIN))
            cols = features(mine, before, after, not near and not follows)
            self.rows += [number] * len(cols)
            self.cols += cols
            for link, key in likeness(mine):
                if (link, key) in last:
                    self.links.append((last[link, key], number, link))
                last[link, key] = number
            self.doc.append(doc)
            self.span.append((lo, hi))
            self.known.append(kind)


class Field:
    """Weights: of node features, of each kind of link, and of the chain."""

    def __init__(self, node: np.ndarray, pair: np.ndarray):
        self.node, self.pair = node, pair

    def unary(self, graph: Graph) -> np.ndarray:
        out = np.zeros((len(graph), N))
        np.add.at(out, np.asarray(graph.rows, np.int64), self.node[np.asarray(graph.cols, np.int64)])
        return out

    def marginals(self, graph: Graph, rounds: int = 30, damping: float = 0.2, enough: float = 1e-4) -> np.ndarray:
        """Probability of each label of each node by loopy message passing; known nodes keep their label."""
        own = self.unary(graph)
        known = np.asarray(graph.known, np.int64)
        fixed = np.flatnonzero(known >= 0)
        own[fixed] = -1e9
        own[fixed, known[fixed]] = 0
        if not graph.links:
            return softmax(own)
        a, b, kind = np.asarray(graph.links, np.int64).T
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        table = np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)])   # [link, source label, target label]
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        message = np.zeros((len(source), N))
        for _ in range(rounds):
            belief = gathered(own, target, message)
            sent = log_sum((belief[source] - message[back])[:, :, None] + table, axis=1)
            sent -= log_sum(sent, axis=1)[:, None]
            sent = damping * message + (1 - damping) * sent
            moved = np.abs(sent - message).max()
            message = sent
            if moved < enough:
                break
        return softmax(gathered(own, target, message))


def gathered(own: np.ndarray, target: np.ndarray, message: np.ndarray) -> np.ndarray:
    return own + np.stack([np.bincount(target, weights=message[:, y], minlength=len(own)) for y in range(N)], axis=1)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(graph: Graph, label: np.ndarray, epochs: int = 150, rate: float = 0.3, l2: float = 1e-4) -> Field:
    """Pseudo-likelihood: each node given the labels of those it is linked with. Link weights are symmetric,
    chain weights are not."""
    model = Field(np.zeros((WIDTH, N)), np.zeros((CHAIN + 1, N, N)))
    n = len(graph)
    if not n:
        return model
    rows, cols = np.asarray(graph.rows, np.int64), np.asarray(graph.cols, np.int64)
    used, cols = np.unique(cols, return_inverse=True)
    weight, pair = np.zeros((len(used), N)), model.pair
    a, b, kind = (np.asarray(graph.links, np.int64).reshape(-1, 3)).T
    truth = np.zeros((n, N))
    truth[np.arange(n), label] = 1
    seen_w, seen_p = np.full(weight.shape, 1e-8), np.full(pair.shape, 1e-8)
    # a kind of node counts by the square root of its number
    share = np.bincount(label, minlength=N)
    cost = (1 / np.sqrt(np.maximum(share, 1)))[label]
    cost *= n / cost.sum()
    for _ in range(epochs):
        score = np.stack([np.bincount(rows, weights=weight[cols, y], minlength=n) for y in range(N)], axis=1)
        np.add.at(score, a, pair[kind, :, label[b]])
        np.add.at(score, b, pair[kind, label[a], :])
        error = (softmax(score) - truth) * cost[:, None]
        slope = np.stack([np.bincount(cols, weights=error[rows, y], minlength=len(used)) for y in range(N)], axis=1) / n + l2 * weight
        of_pair = np.zeros_like(pair)
        np.add.at(of_pair.transpose(0, 2, 1), (kind, label[b]), error[a])
        np.add.at(of_pair, (kind, label[a]), error[b])
        of_pair[:CHAIN] = (of_pair[:CHAIN] + of_pair[:CHAIN].transpose(0, 2, 1)) / 2
        of_pair = of_pair / n + l2 * pair
        seen_w += slope ** 2
        seen_p += of_pair ** 2
        weight -= rate * slope / np.sqrt(seen_w)
        pair -= rate * of_pair / np.sqrt(seen_p)
    model.node[used] = weight
    return model


def respelled(kind: int, text: str, rng: random.Random) -> str:
    """The same datum in a spelling that no base pattern takes."""
    digits = only_digits(text)
    if kind == 0:
        name, domain = text.split("@", 1)
        return rng.choice((f"{name}[at]{domain}", f"{name}(at){domain}", name if len(name) >= 5 else f"{name}[at]{domain}"))
    if kind == 1:
        return rng.choice(("-", "[.]", "_")).join(text.split("."))
    if kind == 2:
        return rng.choice((".", "/", "_")).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    last = f"{digits[-7:-4]}-{digits[-4:]}"
    return rng.choice((last, f"({digits[-10:-7]}) {last}", f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}"))


def with_mentions(text: str, base: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with a respelled mention of each base span, or of as many others as there are, and a decoy for each;
    and the label spans of the mentions."""
    added = []
    for kind, lo, hi in base:
        said = text[lo:hi]
        decoy = "".join(rng.choice("0123456789") if c.isdigit() else rng.choice("abcdefghiklmnoprstuvw") if c.isalpha() else c for c in said)
        for of, label in ((said, kind), (decoy, None)):
            again = respelled(kind, of, rng)
            added.append((rng.choice((again, again, f"{again}.", f"({again})")), label, again))
    rng.shuffle(added)
    spans = []
    for token, label, again in added:
        text += rng.choice((" ", "\n")) + rng.choice(("la ", "und ", "the ", "of ", "")) if rng.random() < 0.8 else " or "
        if label is not None:
            lo = len(text) + token.index(again)
            spans.append((label, lo, lo + len(again)))
        text += token
        text += " and"
    return text, spans


def read_graph(texts: pa.Array, graph: Graph | None = None) -> tuple[Graph, dict[int, list[tuple[int, int, int]]]]:
    """The graph of a slice of texts and their base spans."""
    graph = Graph() if graph is None else graph
    data, offsets = utf8(texts)
    marked = np.concatenate([[0], np.cumsum(_DIGIT_OR_AT[data])])
    docs = np.flatnonzero(marked[offsets[1:]] > marked[offsets[:-1]])
    spans: dict[int, list[tuple[int, int, int]]] = {}
    if not len(docs):
        return graph, spans
    words = Words(data, offsets, WHITE)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    has = marked[words.ends] > marked[words.starts]
    for d in docs.tolist():
        text = bytes(data[offsets[d]:offsets[d + 1]]).decode("utf-8", "replace")
        base = base_spans(text)
        if base:
            spans[d] = base
        first, last = int(words.bounds[d]), int(words.bounds[d + 1])
        at = first + np.flatnonzero(has[first:last])
        lo, hi = lead[words.starts[at]] - lead[offsets[d]], lead[words.ends[at]] - lead[offsets[d]]

        def plain(i, first=first, last=last):
            return bytes(data[words.starts[i]:words.ends[i]][:64]).decode("utf-8", "replace") if first <= i < last and not has[i] else None
        graph.add(d, text, list(zip(lo.tolist(), hi.tolist(), strict=True)), [(plain(i - 1), plain(i + 1)) for i in at.tolist()], base)
    return graph, spans


def learn(texts: list[str], seed: int = 11) -> Field:
    """Fit on texts, each as it is and with mentions of its base spans added."""
    rng = random.Random(seed)
    made = []
    for t in texts:
        base = base_spans(t)
        made.append((t, []))
        if base:
            made.append(with_mentions(t, base[:20], rng))
    graph, _ = read_graph(pa.array([t for t, _ in made], pa.string()))
    label = np.maximum(np.asarray(graph.known, np.int64), 0)
    for i, (d, (lo, hi)) in enumerate(zip(graph.doc, graph.span, strict=True)):
        if label[i] == 0:
            for kind, s, e in made[d][1]:
                if lo < e and s < hi:
                    label[i] = kind + 1
    return fit(graph, label)


def added_spans(graph: Graph, chance: np.ndarray, texts: pa.Array, threshold: float) -> dict[int, list[tuple[int, int, int, float]]]:
    """``(kind number, start, end, probability)`` by document: words that reach the threshold, neighbours of
    one kind together, without punctuation at the ends."""
    out: dict[int, list[list]] = {}
    linked = {(a, b) for a, b, kind in graph.links if kind == CHAIN}
    before = None
    for i in np.flatnonzero((np.asarray(graph.known) < 0) & (chance[:, 1:].max(axis=1) >= threshold)).tolist() if len(graph) else []:
        kind, (lo, hi) = int(chance[i, 1:].argmax()), graph.span[i]
        own = out.setdefault(graph.doc[i], [])
        if before == i - 1 and (i - 1, i) in linked and own and own[-1][0] == kind:
            own[-1][2], own[-1][3] = hi, min(own[-1][3], float(chance[i, kind + 1]))
        else:
            own.append([kind, lo, hi, float(chance[i, kind + 1])])
        before = i
    found = {}
    for d, own in out.items():
        text = texts[d].as_py()
        for s in own:
            core = text[s[1]:s[2]]
            s[1] += len(core) - len(re.sub(r"^[^A-Za-z0-9(+]+", "", core))
            s[2] -= len(core) - len(re.sub(r"[^A-Za-z0-9]+$", "", core))
        found[d] = [tuple(s) for s in own]
    return found


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                      T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())])
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))


def _find(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                graph, base = read_graph(texts)
                more = added_spans(graph, model.value.marginals(graph), texts, threshold) if len(graph) else {}
                out: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for d in base.keys() | more.keys():
                    spans = [(k, lo, hi, True, 1.0) for k, lo, hi in base.get(d, [])] + [(k, lo, hi, False, p) for k, lo, hi, p in more.get(d, [])]
                    out[d] = [{"kind": KINDS[k], "start": lo, "end": hi, "base": b, "score": p} for k, lo, hi, b, p in sorted(spans)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, _SPAN_ARROW)], names=["id", "spans"])
    return run


def _sample(size: int, chars: int):
    """Of each kind, and of texts without one, the ``size`` texts of a task with the smallest hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, dict[int, str]] = {k: {} for k in range(-1, len(KINDS))}
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for kind in {k for k, _, _ in base_spans(text)} or {-1}:
                    own = least[kind]
                    own[h] = text
                    if len(own) >= 2 * size:
                        least[kind] = {x: own[x] for x in sorted(own)[:size]}
        rows = [(k, h, own[h]) for k, own in least.items() for h in sorted(own)[:size]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.string()))], names=["kind", "h", "text"])
    return run


def fit_on(documents: DataFrame, text_col: str = "text", sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> Field:
    """Learn from a bounded sample of ``documents``; at most 5 * ``sample_texts`` texts reach the driver."""
    text = F.col(text_col).cast("string")
    some = documents.select(F.xxhash64(text).alias("h"), text.alias("text")).filter(
        (F.char_length("text") <= sample_chars) & F.col("text").rlike("[0-9@]"))
    least = some.mapInArrow(_sample(sample_texts, sample_chars), "kind int, h long, text string").dropDuplicates(["kind", "h"])
    for by in (["kind", F.pmod("h", F.lit(64))], ["kind"]):      # in two steps, so that no task ranks the rows of all tasks
        least = least.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h", "text"))).filter(F.col("n") <= sample_texts)
    rows = least.select("h", "text").distinct().collect()
    return learn([r.text for r in sorted(rows, key=lambda r: (r.h, r.text))])


def find_personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Field | None = None, threshold: float = 0.9) -> DataFrame:
    """Personal data of every whole text: the id and ``spans``, an array of (kind, start, end, base, score), by kind
    (email, ip, card, phone), then start; places are code points, the end exclusive.

    ``base`` spans are what the patterns match; the others are words that the field judges to be of the kind
    with a probability (``score``) of at least ``threshold``; these never overlap a base span. Without a given
    ``model`` one is learned from these documents.

    Null or empty text has no spans; repeated rows get equal spans; a table without a base span adds none;
    an empty table gives no rows. Other columns are not read, whatever their names. A text is held whole by the
    task that reads it, beside some hundred bytes for each of its words with a digit or at sign.
    """
    model = fit_on(documents, text_col) if model is None else model
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_find(shared, threshold), T.StructType([T.StructField("id", field(documents, id_col).dataType), T.StructField("spans", T.ArrayType(_SPAN))]))
    return out.withColumnRenamed("id", id_col)
