import hashlib
import heapq
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import types as T

from spreadwise.llm import conversation_repair as cr
from spreadwise.llm.queries import op11_conversation_repair

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
WORD, LEGAL = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"(s?(ua)+)?")


def damaged(rows):
    """Rows (conv, turn, role, text) after damage, by conversation, in order."""
    out = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (c, turn)).encode()) % 20
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            out[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = WORD.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Uniform-cost search over whole edit sequences, ordered by (cost, audit); merges only on equal
    (row, initials so far), so nothing is known about the grammar but its pattern. A sequence of initials is
    cut to what the pattern can tell apart: whether it is empty, and its last initial."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, lines = heapq.heappop(queue)
        if (i, state) in done:
            continue
        if not audit.endswith("I") or i == len(rows):
            done.add((i, state))
        if i == len(rows) and LEGAL.fullmatch({"": "", "s": "s", "u": "u", "a": "ua"}[state]):
            return cost, audit, lines
        can = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for x, role in (("u", "user"), ("a", "assistant")):
            if x in can and len(re.search("I*$", audit)[0]) < 3:
                heapq.heappush(queue, (cost + 2, audit + "I", i, x, lines + (f"{role}:",)))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state, lines))
            if found[i] not in ("blank", "duplicate"):
                more = cost + (found[i] == "truncated")
                if role[:1] and role[:1] in can:
                    heapq.heappush(queue, (more, audit + "K", i + 1, role[:1], lines + (f"{role}:{text}",)))
                for x, to in (("u", "user"), ("a", "assistant")):
                    if x in can:
                        heapq.heappush(queue, (more + 2, audit + "R", i + 1, x, lines + (f"{to}:{text}",)))


def expected(rows):
    out = []
    for c, own in damaged(rows).items():
        found = faults(own)
        cost, audit, lines = cheapest(own, found)
        turns = {t for t, *_ in own if t is not None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def exhaustive(kinds):
    """Least (cost, audit) over all audits of up to four rows with up to two inserts in each gap."""
    best = None
    for choice in product("KuaD", repeat=len(kinds)):
        if any((must and c != "D") or (c == "K" and not initial) for c, (initial, must, _) in zip(choice, kinds)):
            continue
        for gaps in product(("", "u", "a", "ua", "au"), repeat=len(kinds) + 1):
            initials, audit, cost = "", "", 0
            for gap, c, (initial, _, cut) in zip(gaps, (*choice, ""), (*kinds, ("", 0, 0))):
                initials, audit, cost = initials + gap, audit + "I" * len(gap), cost + 2 * len(gap)
                if c:
                    initials += {"K": initial, "D": ""}.get(c, c)
                    audit += c if c in "KD" else "R"
                    cost += {"K": 0, "D": 3}.get(c, 2) + (c != "D" and cut)
            if LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_parser_finds_the_least_of_all_repairs(n):
    kinds = [("s", False, False), ("u", False, False), ("a", False, True), ("x", False, False), ("", False, True), ("u", True, False)]
    for rows in product(kinds if n < 3 else kinds[1:5:2] + kinds[2:3], repeat=n):
        whole = {0: cr.parse(rows, 0)}
        cost, parts = cr.choose([whole])
        assert (cost, parts[0][1]) == exhaustive(rows), rows
        # cut anywhere, the runs' tables lead to the same repair
        for cut in range(1, n):
            tables = [{s: cr.parse(part, s) for s in cr.STACKS} for part in (rows[:cut], rows[cut:])]
            cost2, parts = cr.choose(tables)
            assert (cost2, "".join(a for _, a in parts)) == (cost, exhaustive(rows)[1])


def rows_of(spark, df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def write(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return str(folder)


def made_up():
    texts = ["Hello.", "Hello", " \t\n", "", "What? ", "Done!\n", None, "é", "ends. ", "x" * 200_000 + "."]
    roles = ["user", "assistant", "system", None, "tool", "", "user", "assistant"]
    rows = [(c, t, roles[(c * 7 + t * 3) % 8], texts[(c * 5 + t * t) % 10]) for c in range(60) for t in range((c * 13) % 17)]
    rows += [(99, None, "user", "a."), (99, None, "user", "a."), (99, 2, "user", "a."), (99, 9, "assistant", "b"), (99, 9, "assistant", "b"), (99, 9, "aid", "a")]
    rows += [(None, 1, "user", "q."), (None, None, "assistant", "r."), (100, None, None, None)]
    rows += [(200, t, ("user", "assistant")[t % 2], f"turn {t % 97}.") for t in range(3_000)]
    return rows


def test_query_equals_the_search_over_edit_sequences(spark, tmp_path):
    rows = made_up()
    assert rows_of(spark, op11_conversation_repair(spark, write(spark, tmp_path, rows))) == expected(rows)


def test_runs_of_one_conversation_may_lie_in_many_tasks(spark, tmp_path):
    rows = [r for r in made_up() if r[0] in (200, 5, None)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert rows_of(spark, op11_conversation_repair(spark, write(spark, tmp_path, rows))) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_edits_are_the_repair(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Yes."), (1, 2, "user", ""), (1, 3, "user", "And"), (2, 0, "user", "Q?")]
    summary, edits = cr.repair_conversations(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: (r.cost, r.audit) for r in summary.collect()}
    assert got == {c: cheapest_of(rows, c) for c in (1, 2)}
    for c in (1, 2):
        mine = sorted((r for r in edits.collect() if r.conv_id == c), key=lambda r: (r.seg, r.at))
        assert "".join(r.edit for r in mine) == got[c][1]
        assert LEGAL.fullmatch("".join(r.role[:1] for r in mine if r.edit != "D"))
        assert [r.turn for r in mine if r.edit != "I"] == [t for k, t, *_ in rows if k == c]


def cheapest_of(rows, conv):
    own = [r[1:] for r in rows if r[0] == conv]
    return cheapest(own, faults(own))[:2]


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert op11_conversation_repair(spark, write(spark, tmp_path / "none", [])).count() == 0
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b.")]
    wide = spark.createDataFrame([(*r, 5, "x", "y", "z") for r in rows], T.StructType([*SCHEMA.fields, *(
        T.StructField(n, t) for n, t in (("conv", T.LongType()), ("key", T.StringType()), ("seg", T.StringType()), ("of", T.StringType())))]))
    wide.write.parquet(f"{tmp_path}/wide/conversations.parquet")
    assert rows_of(spark, op11_conversation_repair(spark, f"{tmp_path}/wide")) == expected(rows)
