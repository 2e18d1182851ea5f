"""Operator 11: conversation structure repair by generalised LR parsing.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. The parser is the LR automaton
of that grammar over a graph-structured stack: after each row there is one node for each stack top,
which points to the stack below it, and several tops share what lies below them. A row may be
kept, reroled or deleted, and turns may be inserted before it, each at a price. Nodes with equal tops
merge: the one with the least (cost, audit) stays. In this grammar equal tops accept the same
continuations, and inserts are made only right before the row that follows them (or at the end), so
no audit at a level is the beginning of another: the merge loses no cheapest, ASCII-least repair.

Spark deals rows by ranges of (conversation, turn, ...), so a conversation of any length is cut into
runs of even size. Each task parses its runs; a run that may continue in another task is parsed from
every stack top it can begin with. One small row for each run then meets the others of its
conversation, the cheapest chain of runs is chosen, and the edits go back to the runs. No task holds
more rows than its range, and no text takes part in the choice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import crc_mod, field, staged

# LR states of  C -> (empty) | T | s T,  T -> T P | P,  P -> u a
SHIFT = {(0, "s"): 2, (0, "u"): 3, (2, "u"): 3, (4, "u"): 3, (6, "u"): 3, (3, "a"): 7}
REDUCE = {5: ("T", 1), 7: ("P", 2), 8: ("T", 2)}
GOTO = {(0, "P"): 5, (2, "P"): 5, (4, "P"): 8, (6, "P"): 8, (0, "T"): 4, (2, "T"): 6}
ACCEPT = (0, 4, 6)
LEGAL_PAIRS = ("su", "ua", "au")

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
ROLES = {"u": "user", "a": "assistant"}

#: a stack for each top that stays after reductions, as linked (state, below)
EMPTY = (0, None)
STACKS = {0: EMPTY, 2: (2, EMPTY), 3: (3, (4, EMPTY)), 4: (4, EMPTY), 6: (6, (2, EMPTY))}


def shift(stack: tuple, symbol: str) -> tuple | None:
    """The stack after a symbol and all reductions that follow, or None if the symbol cannot stand here."""
    to = SHIFT.get((stack[0], symbol))
    if to is None:
        return None
    stack = (to, stack)
    while stack[0] in REDUCE:
        head, size = REDUCE[stack[0]]
        for _ in range(size):
            stack = stack[1]
        stack = (GOTO[stack[0], head], stack)
    return stack


@lru_cache(maxsize=None)
def inserts(stack: tuple) -> tuple:
    """``(stack, cost, audit)`` after inserting nothing, or turns, until a top comes again."""
    found, seen = [(stack, 0, "")], {stack[0]}
    for at, cost, audit in found:
        for symbol in ROLES:
            after = shift(at, symbol)
            if after is not None and after[0] not in seen:
                seen.add(after[0])
                found.append((after, cost + INSERT, audit + "I"))
    return tuple(found)


@lru_cache(maxsize=None)
def moves(stack: tuple, initial: str, must_go: bool, truncated: bool) -> tuple:
    """Everything that may be done with a row on top of ``stack``, as ``(stack, cost, audit)``."""
    found = [(stack, DELETE, "D")]
    if not must_go:
        extra = TRUNCATED if truncated else 0
        for at, cost, audit in inserts(stack):
            for symbol, price, letter in ((initial, 0, "K"), *((r, REROLE, "R") for r in ROLES)):
                after = shift(at, symbol)
                if after is not None:
                    found.append((after, cost + price + extra, audit + letter))
    return tuple(found)


def advance(level: list, options) -> tuple[list, list]:
    """One level on: ``level`` holds ``(stack, cost)`` in the order of their audits, ``options(stack)`` the
    ways on. Of equal tops the least (cost, audit) stays. Returns the new level and, for each of its
    nodes, ``(index of the node before, piece of audit)``."""
    best: dict[int, tuple] = {}
    for i, (stack, cost) in enumerate(level):
        for after, price, piece in options(stack):
            label = (cost + price, i, piece)
            if after[0] not in best or label < best[after[0]][0]:
                best[after[0]] = (label, after)
    nodes = sorted(best.values(), key=lambda x: x[0][1:])
    return [(stack, label[0]) for label, stack in nodes], [label[1:] for label, _ in nodes]


def trace(back: list, at: int) -> list[str]:
    """Pieces of audit that lead to node ``at`` of the last level."""
    pieces = []
    for level in reversed(back):
        at, piece = level[at]
        pieces.append(piece)
    return pieces[::-1]


def parse(rows: list[tuple], start: int) -> list[tuple[int, int, str]]:
    """``(top, cost, audit)`` of each stack top that ``rows`` ``(initial, must_go, truncated)`` may end with."""
    level, back = [(STACKS[start], 0)], []
    for row in rows:
        level, step = advance(level, lambda stack, row=row: moves(stack, *row))
        back.append(step)
    return [(stack[0], cost, "".join(trace(back, i))) for i, (stack, cost) in enumerate(level)]


def choose(tables: list[dict[int, list]]) -> tuple[int, list[tuple[int, str]]]:
    """Least (cost, audit) through the runs' tables ``{start: [(top, cost, audit)]}``: the cost, and for
    each run the top it begins with and its audit."""
    level, back, tops = [(EMPTY, 0)], [], []
    for table in tables:
        tops.append([stack[0] for stack, _ in level])
        level, step = advance(level, lambda stack, table=table: [(STACKS[top], cost, audit) for top, cost, audit in table.get(stack[0], ())])
        back.append(step)
    ends = [(cost + price, i, piece) for i, (stack, cost) in enumerate(level)
            for after, price, piece in inserts(STACKS[stack[0]]) if after[0] in ACCEPT]
    cost, at, tail = min(ends)
    audits, at_level = trace(back, at), at
    begins = []
    for level_back, top in zip(reversed(back), reversed(tops), strict=True):
        at_level = level_back[at_level][0]
        begins.append(top[at_level])
    if audits:
        audits[-1] += tail
    return cost, list(zip(begins[::-1], audits, strict=True))


def edits_of(rows: list[dict], start: int, audit: str) -> Iterator[tuple[str, int | None, str, str]]:
    """``(edit, row, role, text)`` of a run; an inserted turn has no row and empty text."""
    expected, i = ("a" if start == 3 else "u"), 0
    for letter in audit:
        if letter == "I":
            yield letter, None, ROLES[expected], ""
        else:
            row = rows[i]
            yield letter, i, ROLES[expected] if letter == "R" else row["role"], row["text"]
            i += 1
            if letter == "D" or (letter == "K" and row["role"][:1] == "s"):
                continue
        expected = "a" if expected == "u" else "u"


def _string(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, text)`` with known damage, by crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1
    empties its text, 2 takes its full stops, exclamation and question marks, 3 doubles it, 4 makes it
    the user's. Nulls count as one space, in the hash as well; ids and turns stay null."""
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), _string(role_col).alias("role"), _string(text_col).alias("text"))
    rows = rows.withColumn("key", F.concat_ws(":", _string("conv"), _string("turn"))).withColumn("kind", crc_mod("key", 20))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("kind <> 0").select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                                           text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


_TABLE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("top", T.IntegerType()),
                                   T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_COUNTS = ("n_turns", "blank", "duplicate", "truncated", "illegal")


def _runs_schema(conv, turn) -> T.StructType:
    row = T.StructType([T.StructField("turn", turn), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return T.StructType([
        T.StructField("conv", conv), T.StructField("seg", T.LongType()), *(T.StructField(c, T.LongType()) for c in _COUNTS),
        T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("first_turn", T.LongType()), T.StructField("last_turn", T.LongType()),
        T.StructField("first_initial", T.StringType()), T.StructField("last_initial", T.StringType()),
        T.StructField("paths", _TABLE), T.StructField("rows", T.ArrayType(row))])


def _run_row(conv, seg: int, rows: list[dict], whole: bool) -> dict:
    out = {"conv": conv, "seg": seg} | dict.fromkeys(_COUNTS, 0)
    turns = [r["number"] for r in rows]
    known = [t for t in turns if t is not None]
    out |= {"n_turns": len(set(known)), "low": min(known, default=None), "high": max(known, default=None), "first_turn": turns[0], "last_turn": turns[-1]}
    kinds, before = [], None
    for r in rows:
        same = before is not None and (before["number"], before["role"], before["text"]) == (r["number"], r["role"], r["text"])
        blank, again = r["blank"], r["again"] or same
        if blank:
            out["blank"] += 1
        elif again:
            out["duplicate"] += 1
        elif r["cut"]:
            out["truncated"] += 1
        kinds.append((r["role"][:1], blank or again, r["cut"]))
        out["illegal"] += before is not None and before["role"][:1] + r["role"][:1] not in LEGAL_PAIRS
        before = r
    out |= {"first_initial": rows[0]["role"][:1], "last_initial": rows[-1]["role"][:1]}
    out["paths"] = [{"start": s, "top": top, "cost": cost, "audit": audit}
                    for s in ((0,) if whole else STACKS) for top, cost, audit in parse(kinds, s)]
    out["rows"] = [{k: r[k] for k in ("turn", "role", "text")} for r in rows]
    return out


def _runs(schema: pa.Schema):
    """Sorted rows of a range to runs. The first and the last run of a task may go on in another task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 40
        rows, conv, first = [], None, True
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if rows and r["conv"] != conv:
                    done.append(_run_row(conv, seg, rows, whole=not first))
                    rows, first, seg = [], False, seg + 1
                conv = r["conv"]
                rows.append(r)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if rows:
            yield pa.RecordBatch.from_pylist([_run_row(conv, seg, rows, whole=False)], schema)
    return run


_CHOICE = T.ArrayType(T.StructType([T.StructField("seg", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("audit", T.StringType())]))


def _decide(schema: pa.Schema):
    """Runs of each conversation, in order, to its counts, cost, audit and the runs' shares of the audit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                runs = c["runs"]
                tables = []
                for r in runs:
                    table: dict[int, list] = {}
                    for p in r["paths"]:
                        table.setdefault(p["start"], []).append((p["top"], p["cost"], p["audit"]))
                    tables.append(table)
                cost, parts = choose(tables)
                row = {k: sum(r[k] for r in runs) for k in _COUNTS}
                for a, b in zip(runs, runs[1:], strict=False):
                    row["n_turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
                    row["illegal"] += a["last_initial"] + b["first_initial"] not in LEGAL_PAIRS
                lows, highs = [r["low"] for r in runs if r["low"] is not None], [r["high"] for r in runs if r["high"] is not None]
                turns = row.pop("n_turns")
                row |= {"conv": c["conv"], "gaps": max(highs) - min(lows) + 1 - turns if lows else 0, "cost": cost, "audit": "".join(a for _, a in parts)}
                row["choice"] = [{"seg": r["seg"], "start": s, "audit": a} for r, (s, a) in zip(runs, parts, strict=True)]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _edit_rows(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for at, (edit, i, role, text) in enumerate(edits_of(r["rows"], r["start"], r["audit"])):
                    turn = None if i is None else r["rows"][i]["turn"]
                    out.append({"conv": r["conv"], "seg": r["seg"], "at": at, "edit": edit, "turn": turn, "role": role, "text": text})
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def repair_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Cheapest repair of every conversation, as two tables.

    ``summary``: one row for each conversation: the id, ``gaps`` (missing turns between the least and
    the greatest), ``blank`` / ``duplicate`` / ``truncated`` (rows by their first fault), ``illegal`` (adjacent
    initials other than su, ua, au), ``cost`` and ``audit`` (initials of the edits: Keep, Rerole, Delete,
    Insert; of all cheapest ones the ASCII-least).

    ``edits``: one row for each edit, in order of (``seg``, ``at``) within a conversation: ``edit``, the old
    ``turn`` (null if inserted), and ``role`` and ``text`` after the edit (deleted rows keep theirs). The repaired
    conversation is all that is not deleted.

    Rows are taken by turn, nulls first; equal turns by role, first 64 characters of the text and a
    digest of both, so equal rows stand together. A null role or text is one space, a null id is a
    conversation of its own. Repeated rows are duplicates; empty texts and texts of white space are blank;
    an empty table gives two empty tables. Other columns are not read, whatever their names. A text is
    held whole, but only those of one task's range at a time.
    """
    turn_type, conv_type = field(conversations, turn_col).dataType, field(conversations, conv_col).dataType
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), _string(role_col).alias("role"), _string(text_col).alias("text"))
    rows = rows.withColumn("key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # a role and text that come in several turns: rows after the first such turn are duplicates
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = (rows.groupBy("conv", "key").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last")))
             .select(F.col("conv").alias("of"), F.col("key").alias("what"), "first"))
    rows = rows.join(again, F.col("conv").eqNullSafe(F.col("of")) & (F.col("key") == F.col("what")), "left")
    rows = rows.select(
        "conv", "turn", "role", "text", "key", F.col("turn").cast("long").alias("number"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (F.col("what").isNotNull() & ~place.eqNullSafe(F.col("first"))).alias("again"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"))
    order = ["conv", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64)), "key"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("key")
    schema = _runs_schema(conv_type, turn_type)
    runs = staged(dealt.mapInArrow(_runs(_arrow(schema)), schema), "runs")

    schema = T.StructType([T.StructField("conv", conv_type), *(T.StructField(c, T.LongType()) for c in ("gaps", *_COUNTS[1:], "cost")),
                           T.StructField("audit", T.StringType()), T.StructField("choice", _CHOICE)])
    parts = F.struct("seg", *[c for c in runs.columns if c not in ("conv", "seg", "rows")])
    decided = staged(runs.groupBy("conv").agg(F.sort_array(F.collect_list(parts)).alias("runs"))
                     .mapInArrow(_decide(_arrow(schema)), schema), "repairs")

    shares = decided.select(F.explode("choice").alias("c")).select("c.*")
    schema = T.StructType([T.StructField("conv", conv_type), T.StructField("seg", T.LongType()), T.StructField("at", T.LongType()), T.StructField("edit", T.StringType()),
                           T.StructField("turn", turn_type), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    edits = runs.select("conv", "seg", "rows").join(shares, "seg").mapInArrow(_edit_rows(_arrow(schema)), schema)
    return (decided.drop("choice").withColumnRenamed("conv", conv_col),
            edits.select(F.col("conv").alias(conv_col), "seg", "at", "edit", F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col)))


def _digests(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            done = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "role", "text")), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        done.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], schema)
    return run


def repaired_digests(edits: DataFrame, conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, repaired_sha256)`` of each conversation with a row left: SHA-256 of its ``role:text`` lines.

    A digest is sequential by nature, so a conversation's lines stream through one task, one batch at a time.
    """
    schema = T.StructType([T.StructField("conv", field(edits, conv_col).dataType), T.StructField("repaired_sha256", T.StringType())])
    kept = edits.filter("edit <> 'D'").select(F.col(conv_col).alias("conv"), "seg", "at", F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    return kept.repartition("conv").sortWithinPartitions("conv", "seg", "at").select("conv", "role", "text").mapInArrow(_digests(_arrow(schema)), schema)
