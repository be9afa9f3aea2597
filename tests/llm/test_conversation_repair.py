import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from groundplan.llm.conversation_repair import Report, automaton, damaged, op13_conversation_repair, repaired, symbol

from .helpers import SF, real

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain(rows):
    """Cheapest edits by trying all ways, with whole strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @cache
    def least(i, roles, budget):
        """(cost, audit, lines) from row i on, where what there is so far ends as roles (its state) says."""
        ways = []
        if i == len(rows):
            if roles in ("", "a"):
                ways.append((0, "", ()))
        else:
            role, text, fault = rows[i][2], rows[i][3], faults[i]
            for edit, cost, new in [("D", 2, None), ("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")]:
                to = roles if new is None else step(roles, new[:1])
                if to is None or edit != "D" and fault in ("blank", "duplicate"):
                    continue
                rest = least(i + 1, to, budget)
                if rest:
                    more = 5 if fault == "truncated" and edit != "D" else 0
                    ways.append((cost + more + rest[0], edit + rest[1], (() if new is None else (f"{new}:{text}",)) + rest[2]))
        if budget:
            for new in ("user", "assistant"):
                to = step(roles, new[0])
                rest = least(i, to, budget - 1) if to is not None else None
                if rest:
                    ways.append((5 + rest[0], "I" + rest[1], (f"{new}:",) + rest[2]))
        return min(ways) if ways else None

    def step(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    cost, audit, lines = least(0, "", 4)
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows):
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    return {c: plain(x) for c, x in by.items()}


def found(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_query_equals_plain_version(spark):
    out = op13_conversation_repair(spark, SF)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [(int(r.conv_id), None if r.turn != r.turn else int(r.turn), r.role, r.text) for r in real("conversations").itertuples()]
    assert found(out) == expected(rows)


def test_all_short_signatures():
    """Every sequence of up to four rows of all kinds, against all edits tried out."""
    costs, arcs = automaton()
    assert len(costs) < 100 and len(arcs) == 16 * len(costs)
    texts = {0: "x{}.", 1: " ", 3: "x{}"}
    for n in range(5):
        for kinds in itertools.product([("s", 0), ("u", 0), ("a", 0), ("x", 0), ("u", 1), ("u", 3), ("a", 3), ("s", 3)], repeat=n):
            rows = [(1, k, {"s": "system", "u": "user", "a": "assistant", "x": "tool"}[i], texts[f].format(k)) for k, (i, f) in enumerate(kinds)]
            dup = [f if f != 1 or all(r[2:] != rows[k][2:] for r in rows[:k]) else 1 for k, (_, f) in enumerate(kinds)]
            report = Report(bytes(symbol(i, f) for (i, _), f in zip(kinds, dup)))
            for r in rows:
                report.row(*r[1:])
            audit = report.columns()
            assert audit == plain(rows), kinds


def case(rng, n):
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"])
    text = lambda: rng.choice(["Yes.", "No!", "what", "", " \t\n", None, "ends. \n", "nbsp ", "é?", "x" * 5000, "%d." % rng.randint(0, 99)])
    return [(rng.choice([None, *range(12)]), rng.choice([None, *range(9)]), role(), text()) for _ in range(n)]


@pytest.mark.parametrize("parts", ["1", "4", "23"])
def test_edges(spark, parts):
    """Nulls, ties, repeated rows, and conversations that ranges cut, some of them over many."""
    rng = random.Random(int(parts))
    rows = case(rng, 300)
    rows += rows[:40] + [(7, t, "user" if t % 2 else "assistant", "Line %d." % (t // 3)) for t in range(-60, 60)]
    rows += [(99, None, "user", "Same.")] * 30 + [(-1, 3, "user", "Alone.")]
    names = {"spark.sql.shuffle.partitions": parts, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "2 as copy", "true as live", "3 as digest").repartition(5)
        got = found(repaired(damaged(df)))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == expected(rows)


def test_empty_table_and_ids_of_another_type(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repaired(damaged(df)).count() == 0
    rows = [("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes."), (None, 1, "system", "Be kind.")]
    got = found(repaired(damaged(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))))
    assert got == expected(rows)
