"""Repair of the role structure of conversations by cheapest edits, shared over all conversations by a minimised automaton.

A row's symbol is its role's initial and its fault; a conversation's symbols in order are its signature. Signatures are read from
the end. What matters of a suffix is only, for each state of the grammar `(s?(ua)+)?`, its cost-to-go less the least of them, and the
order of its best audits. Suffixes that agree in this are one node, so all suffixes of all conversations share the same few nodes: the
node before a symbol follows from the node after it, cost-to-go and best edits are worked out once for each node, symbol and state, and
the least cost moves to the arc (weights are pushed). The whole automaton is closed under all symbols; reading a signature from the
end looks up arcs, and going forward again spells out the edits.

Rows are partitioned by ranges of (conversation, turn, ...), so a conversation of any size is spread over tasks and no text is
shuffled more than once for those that lie within a range. The conversations at the ends of ranges may be cut; they
come again: duplicates by a minimum per (conversation, role and text), places by ranges, and last, all rows of a
conversation in order through one task, first their symbols (a byte a row), then their texts as a stream, for the hash of a whole repaired
conversation can't be had otherwise.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, table

# ---- the automaton ---------------------------------------------------------------------------------------------------

#: States: nothing yet, after system, after user, after assistant; the moves of role initials.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = {"u": "user", "a": "assistant"}
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "suax"
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 1, 2, 5, 5
#: After the last row: what is inserted from each state, as edits and as initials of roles.
LAST = (("", ""), ("II", "ua"), ("I", "a"), ("", ""))


def symbol(initial: str, fault: int) -> int:
    at = INITIALS.find(initial) if initial else -1
    return 4 * (at if at >= 0 else 3) + fault


def _before(costs: tuple, ranks: tuple, sym: int) -> tuple[tuple, tuple, int, tuple]:
    """The node before a symbol: costs, ranks, the cost that moves to the arc, and for each state (edits, inserted initials, new role or "", next state).

    Edits that end with the row's own letter differ from each other before the shorter one ends, so they compare as letters, then by the
    rank of what follows.
    """
    initial, fault = INITIALS[sym // 4], sym % 4
    best = []
    for g in range(4):
        ways = [(DELETE + costs[g], "D", ranks[g], "", "", g)]
        if fault in (OK, TRUNCATED):
            more = STAYS_TRUNCATED if fault == TRUNCATED else 0
            if initial in MOVES[g]:
                to = MOVES[g][initial]
                ways.append((more + costs[to], "K", ranks[to], "", "", to))
            ways += [(REROLE + more + costs[to], "R", ranks[to], "", r, to) for r, to in MOVES[g].items() if r in ROLES]
        best.append(min(ways))
    for _ in range(4):  # no more inserts than states can pay
        for g in range(4):
            for r, to in MOVES[g].items():
                if r in ROLES:
                    cost, edits, rank, inserted, role, after = best[to]
                    best[g] = min(best[g], (INSERT + cost, "I" + edits, rank, r + inserted, role, after))
    least = min(b[0] for b in best)
    order = sorted({(b[1], b[2]) for b in best})
    return tuple(b[0] - least for b in best), tuple(order.index((b[1], b[2])) for b in best), least, tuple((b[1], b[3], b[4], b[5]) for b in best)


@functools.cache
def automaton() -> tuple[list, dict]:
    """(costs of each node, arcs); arcs[node after, symbol] = (node before, cost, edits for each state). Node 0 is the end. It is finite and small."""
    ends = (0, INSERT * 2, INSERT, 0), (0, 2, 1, 0)
    number, todo, arcs = {ends: 0}, [ends], {}
    for node in todo:
        for sym in range(16):
            costs, ranks, cost, edits = _before(*node, sym)
            if (costs, ranks) not in number:
                number[costs, ranks] = len(todo)
                todo.append((costs, ranks))
            arcs[number[node], sym] = number[costs, ranks], cost, edits
    return [costs for costs, _ in todo], arcs


def cheapest(signature: bytes) -> tuple[int, Iterator[tuple[str, str, str]]]:
    """(cost, for each row and the end (edits, inserted initials, new role or "")): the cheapest edits, of equals those that come first in ASCII."""
    costs, arcs = automaton()
    after, node, total = array("H", bytes(2 * len(signature))), 0, 0
    for i in range(len(signature) - 1, -1, -1):
        after[i] = node
        node, cost, _ = arcs[node, signature[i]]
        total += cost

    def forward() -> Iterator[tuple[str, str, str]]:
        g = 0
        for i, sym in enumerate(signature):
            edits, inserted, role, g = arcs[after[i], sym][2][g]
            yield edits, inserted, role
        yield *LAST[g], ""

    return total + costs[node][0], forward()


class Report:
    """Takes the rows of a conversation in order, after its signature is known."""

    def __init__(self, signature: bytes) -> None:
        faults = [0] * 4
        for sym in range(16):
            faults[sym % 4] += signature.count(sym)
        cost, self.edits = cheapest(signature)
        # of two initials beside each other, these are legal
        legal = {(INITIALS.index(a), INITIALS.index(b)) for a, b in ("su", "ua", "au")}
        illegal = sum((a >> 2, b >> 2) not in legal for a, b in zip(signature, memoryview(signature)[1:]))
        self.counts = (*faults[1:], illegal, cost)
        self.audit, self.hash, self.any = [], hashlib.sha256(), False
        self.turns = 0
        self.first = self.last = None

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        edits, inserted, new = next(self.edits)
        self.audit.append(edits)
        for r in inserted:
            self._line(ROLES[r], "")
        if edits[-1] != "D":
            self._line(ROLES[new] if new else role, text)

    def columns(self) -> tuple:
        edits, inserted, _ = next(self.edits)
        for r in inserted:
            self._line(ROLES[r], "")
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return gaps, *self.counts, "".join(self.audit) + edits, self.hash.hexdigest()


# ---- rows ------------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that crc32 of `conv_id:turn` chooses; a dropped row stays with live false, so that no conversation is lost."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") < 2, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"), (F.col("kind") != 0).alias("live"))


def _facts(rows: DataFrame) -> DataFrame:
    """With what a row shows by itself: state (OK, BLANK or TRUNCATED), digest of role and text, and the text's head, by which equal turns are cut into ranges."""
    bare: Column = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    state = F.when(F.length(bare) == 0, BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)), 1, 16)
    return rows.select("conv_id", "turn", "role", "text", "copy", "live", state.alias("state"), digest.alias("digest"), F.substring("text", 1, 32).alias("head"))


RANGE = ["conv_id", "turn", "role", "head"]
ORDER = ["conv_id", "turn", "role", "text", "copy"]


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange(*RANGE).sortWithinPartitions(*ORDER)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, object, list[dict]]]:
    """(type of the ids, conversation, rows of it that stand together in a batch)."""
    for batch in batches:
        rows, i = batch.to_pylist(), 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j]["conv_id"] == rows[i]["conv_id"]:
                j += 1
            yield batch.schema.field("conv_id").type, rows[i]["conv_id"], rows[i:j]
            i = j


def _out(conv: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [conv, pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv_id", "cut", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reports of all conversations of a range but the first and the last, of which only the ids come."""
    none = object()
    current, first, own, out = none, True, [], []

    def done() -> tuple:
        seen, signature = set(), bytearray()
        for r in own:
            later = r["digest"] in seen
            seen.add(r["digest"])
            signature.append(symbol(r["role"][:1], DUPLICATE if later and r["state"] != BLANK else r["state"]))
        report = Report(bytes(signature))
        for r in own:
            report.row(r["turn"], r["role"], r["text"])
        return current, False, *report.columns()

    for kind, conv, rows in _runs(batches):
        if conv != current or current is none:
            if current is not none:
                out.append((current, True, *[None] * 8) if first else done())
                first = False
            current, own = conv, []
        if not first:
            own += [r for r in rows if r["live"]]
        if len(out) >= 2000:
            yield _out(kind, out)
            out = []
    if current is not none:
        out.append((current, True, *[None] * 8))
    if out:
        yield _out(kind, out)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their places; the first row of each run has the symbols of the run."""
    part, k, before = TaskContext.get().partitionId(), 0, None
    for kind, conv, rows in _runs(batches):
        signature, live = bytearray(), [r for r in rows if r["live"]]
        for r in live:
            again = r["later"] or before == (conv, r["turn"], r["digest"])
            before = conv, r["turn"], r["digest"]
            signature.append(symbol(r["role"][:1], DUPLICATE if again and r["state"] != BLANK else r["state"]))
        rows, n = live or rows[:1], max(1, len(live))
        symbols = pa.array([bytes(signature), *[None] * (n - 1)], pa.binary())
        own = [pa.array([r[c] for r in rows], t) for c, t in (("live", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()))]
        yield pa.RecordBatch.from_arrays([pa.array([conv] * n, kind), pa.array([part] * n, pa.int32()), pa.array(range(k, k + n), pa.int64()), symbols, *own], names=["conv_id", "part", "k", "symbols", "live", "turn", "role", "text"])
        k += n


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's symbols, then its rows in order."""
    none = object()
    current, signature, report = none, bytearray(), None
    for kind, conv, rows in _runs(batches):
        if conv != current or current is none:
            if current is not none:
                yield _out(kind, [(current, False, *(report or Report(bytes(signature))).columns())])
            current, signature, report = conv, bytearray(), None
        for r in rows:
            if r["symbols"] is not None:
                signature += r["symbols"]
            else:
                report = report or Report(bytes(signature))
                report.row(r["turn"], r["role"], r["text"])
    if current is not none:
        yield _out(kind, [(current, False, *(report or Report(bytes(signature))).columns())])


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, copy, live): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows count in the order of turn (nulls first), then role and text. Rows that are not live show only that their conversation
    exists; one without live rows has zeros, an empty audit and the hash of nothing. A null conv_id is a conversation of its own. A role
    that is not of initial s, u or a, the empty one included, can't be kept. Repeated rows are duplicates. Roles and texts are not null. An
    empty table gives an empty table; other columns are not read.
    """
    rows = _facts(rows)
    conv = rows.schema["conv_id"]
    schema = T.StructType([conv, T.StructField("cut", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    found = saved(_in_order(rows).mapInArrow(_whole, schema), "conversations")
    # two for each range at most
    ends = F.broadcast(found.where("cut").select(F.col("conv_id").alias("end")).distinct())
    cut = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("end")), "left_semi")
    least = cut.where("live").groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("least"))
    marked = cut.join(least, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left").withColumn("later", F.coalesce(F.struct("turn") > F.col("least"), F.lit(False))).drop("c", "d", "least")
    places = T.StructType([conv, *T.StructType.fromDDL("part int, k long, symbols binary, live boolean, turn long, role string, text string").fields])
    placed = saved(_in_order(marked).mapInArrow(_placed, places), "placed")
    own = ["conv_id", "part", "k"]
    none = lambda c: F.lit(None).cast(places[c].dataType).alias(c)
    symbols = placed.where("symbols is not null").select(*own, F.lit(0).alias("kind"), "symbols", *map(none, ("turn", "role", "text")))
    texts = placed.where("live").select(*own, F.lit(1).alias("kind"), none("symbols"), "turn", "role", "text")
    stream = symbols.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "k")
    return found.where(~F.col("cut")).union(stream.mapInArrow(_streamed, schema)).drop("cut")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
#: SQL has neither crc32 nor cheapest edits with ties; tests/llm/test_conversation_repair.py compares with a plain version.
ORACLES = {}
