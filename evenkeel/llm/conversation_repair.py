"""Repair of conversations whose turns were lost, emptied, cut, repeated or given the wrong role.

A repaired conversation has the role initials (s?(ua)+)? . The edits, in the order of the rows: Keep a row (0), Rerole it to user or
assistant (2), Delete it (3; blank and duplicate rows have to go), Insert an empty user or assistant turn (2); a truncated row
that isn't deleted adds 1. Of the cheapest series of edits the one whose initials come first in ASCII order is taken.

One integer holds a whole series: the cost in the high digits, below it the edits' initials in octal digits of fixed width, from
the first one on, with zeros at the end. Nodes are (rows done, up to two inserts, state of the pattern); an edge adds its
cost and its digit, and the least integer that reaches a node is the best series there. That is enough for a node: two series of equal
cost that have done the same rows can't be prefixes of one another (the longer one would hold more inserts, which cost),
so their order stays as it is whatever follows.

Rows that are equal in all four columns are one row with a number before anything moves. They are dealt out by
ranges of conversation and turn, so a conversation with a third of all rows lies in many tasks. A task that sees the end of both
neighbours of a conversation has all of it; of the others it returns the integers for each state before and after its rows,
in blocks of BLOCK rows, and those are chained (least sums) in a second step. The digest of such a conversation is taken in
one stream over its rows, which hold no more than one at a time in memory.

Results that are defined: a null role or text is one space (so such a text is blank), null turns come first, rows of one turn stand
by role, then text; null conversations are one conversation; a conversation without rows has zeros, an empty audit and
the digest of no bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import cut

BLOCK = 128
#: Bytes of one conversation's texts that a task keeps; beyond them the digest is taken in the stream.
HELD_BYTES = 32 << 20
SPACE = " \t\n\x0b\f\r"

# What an edit costs.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# The digit of an edit; digits and initials have one order.
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
_INITIALS = str.maketrans({str(d): c for c, d in DIGITS.items()})
# States: nothing yet, after s, after u, after a. What u or a leads to from each, and what a kept row's initial does.
STATES, _NEXT, _KEPT = range(4), (2, 2, 3, 2), ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_BLANK, _DUPLICATE, _CUT = 1, 2, 3


# ---------------------------------------------------------------- integers


def _inserted(best: dict, width: int) -> dict:
    """The nodes after none, one or two inserts."""
    layer = best
    best = dict(best)
    for _ in range(2):
        step = {}
        for state, (value, n) in layer.items():
            to = _NEXT[state]
            value += (INSERT << 3 * width) + (DIGITS["I"] << 3 * (width - 1 - n))
            if to not in step or value < step[to][0]:
                step[to] = (value, n + 1)
        for state, found in step.items():
            if state not in best or found[0] < best[state][0]:
                best[state] = found
        layer = step
    return best


def solve(rows: list[tuple[str, int]], start: int = 0) -> dict[int, tuple[int, int, int]]:
    """rows: (initial, fault). For each state that can be reached after them: (cost, digits, number of digits)."""
    width = 3 * len(rows) + 2
    cost_at = 3 * width
    best = _inserted({start: (0, 0)}, width)
    for initial, fault in rows:
        step: dict[int, tuple[int, int]] = {}
        late = TRUNCATED if fault == _CUT else 0
        may_stay = fault not in (_BLANK, _DUPLICATE)
        for state, (value, n) in best.items():
            digit_at = 3 * (width - 1 - n)
            edges = [(state, DELETE, DIGITS["D"])]
            if may_stay:
                edges.append((_NEXT[state], REROLE + late, DIGITS["R"]))
                if initial in _KEPT[state]:
                    edges.append((_KEPT[state][initial], late, DIGITS["K"]))
            for to, cost, digit in edges:
                reached = value + (cost << cost_at) + (digit << digit_at)
                if to not in step or reached < step[to][0]:
                    step[to] = (reached, n + 1)
        best = _inserted(step, width)
    mask = (1 << cost_at) - 1
    return {state: (value >> cost_at, (value & mask) >> 3 * (width - n), n) for state, (value, n) in best.items()}


Matrix = dict[int, dict[int, tuple[int, int, int]]]


def chained(first: Matrix, then: Matrix) -> Matrix:
    """Two blocks in a row: for each pair of states the least integer over the state between them."""
    out: Matrix = {}
    for start, middles in first.items():
        ends: dict[int, tuple[int, tuple[int, int, int]]] = {}
        width = max((n for _, _, n in middles.values()), default=0) + max((n for m in middles for _, _, n in then.get(m, {}).values()), default=0)
        for middle, (cost, digits, n) in middles.items():
            for end, (more, tail, m) in then.get(middle, {}).items():
                joined = (digits << 3 * m) | tail
                value = (cost + more << 3 * width) | (joined << 3 * (width - n - m))
                if end not in ends or value < ends[end][0]:
                    ends[end] = (value, (cost + more, joined, n + m))
        out[start] = {end: found for end, (_, found) in ends.items()}
    return out


def _all_chained(parts: list[Matrix]) -> Matrix:
    """In pairs, so that integers grow with the levels and not with the blocks."""
    while len(parts) > 1:
        parts = [chained(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def letters(digits: int, n: int) -> str:
    return format(digits, f"0{n}o").translate(_INITIALS) if n else ""


def _best(ends: dict[int, tuple[int, int, int]]) -> tuple[int, str]:
    """Cost and audit of the best series that ends in a whole pattern."""
    width = max(n for _, _, n in ends.values())
    cost, digits, n = min((ends[s] for s in (0, 3) if s in ends), key=lambda x: (x[0] << 3 * width) | (x[1] << 3 * (width - x[2])))
    return cost, letters(digits, n)


def places(audit: str):
    """For each edit its initial and the initial that its turn has in the repaired conversation (None: it has no turn)."""
    turns = len(audit) - audit.count("D")
    at, first = 0, turns % 2
    for edit in audit:
        if edit == "D":
            yield edit, None
        else:
            yield edit, "s" if first and not at else "ua"[(at - first) % 2]
            at += 1


_ROLES = {"u": "user", "a": "assistant"}


class _Writer:
    """The digest of a repaired conversation, row by row."""

    def __init__(self, audit: str):
        self.edits, self.sha, self.begun = places(audit), hashlib.sha256(), False
        self.step()

    def step(self) -> None:
        self.edit, self.initial = next(self.edits, (None, None))

    def put(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.begun else "") + role + ":" + text).encode())
        self.begun = True

    def inserts(self) -> None:
        while self.edit == "I":
            self.put(_ROLES[self.initial], "")
            self.step()

    def row(self, role: str, text: str) -> None:
        self.inserts()
        if self.edit != "D":
            self.put(role if self.edit == "K" else _ROLES[self.initial], text)
        self.step()

    def digest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


# ---------------------------------------------------------------- rows


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: what the damage of the contract leaves, and n = 0 where it drops a row. Nulls of texts and roles are one space."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).cast("int").alias("hit"))
    hit, dropped = F.col("hit"), F.col("hit") == 0
    text = F.when(hit <= 1, F.lit("")).when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(dropped, F.lit("")).when(hit == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(dropped, 0).when(hit == 3, 2).otherwise(1).alias("n"))


_ORDER = ("conv_id", "dated", "turn", "role", "text")


def _faulted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal rows as one with their number, written; and these with the fault of the first of them, dealt out by ranges of conversation and turn.

    The ranges aren't written: files are read back in any order.
    """
    counted = cut(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n")).withColumn("same", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)), "turns")
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    often = counted.where("n > 0").groupBy("conv_id", "same").agg(F.count("*").alias("times"), F.min(at).alias("first")).where("times > 1")
    often = often.select(F.col("conv_id").alias("of"), F.col("same").alias("again"), "first")
    met = counted.join(often, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("again")), "left")
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    fault = F.when(end == "", _BLANK).when(F.col("first").isNotNull() & (at > F.col("first")), _DUPLICATE).when(~end.isin(".", "!", "?"), _CUT).otherwise(0)
    found = met.select("conv_id", F.col("turn").isNotNull().alias("dated"), "turn", "role", "text", "n", fault.alias("fault"))
    return counted, found.repartitionByRange("conv_id", "dated", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions(*_ORDER)


_SEGMENT = "conv_id long, part int, whole boolean, rows long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, cost long, audit string, repaired_sha256 string, starts array<int>, ends array<int>, costs array<long>, series array<string>"
_FIGURES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


class _Segment:
    """The rows of one conversation in one task."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.texts, self.held = conv_id, [], [], 0
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.blocks: list[Matrix] = []
        self.count, self.head, self.tail = 0, None, None

    def add(self, turn, role: str, text: str, n: int, fault: int) -> None:
        if not n:
            return
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        for i in range(n):
            own = fault if i == 0 or fault == _BLANK else _DUPLICATE
            self.blank += own == _BLANK
            self.duplicate += own == _DUPLICATE
            self.truncated += own == _CUT
            if self.count:
                self.illegal += self.tail + initial not in ("su", "ua", "au")
            else:
                self.head = initial
            self.tail, self.count = initial, self.count + 1
            self.rows.append((initial, own))
            if len(self.rows) == 2 * BLOCK:
                self.blocks.append({s: solve(self.rows[:BLOCK], s) for s in STATES})
                del self.rows[:BLOCK]
        self.held += n * (len(text) + len(role))
        if self.held <= HELD_BYTES:
            self.texts.append((role, text, n))
        else:
            self.texts.clear()

    def record(self, part: int, edge: bool) -> dict:
        whole = not edge and self.held <= HELD_BYTES
        out = {"conv_id": self.conv_id, "part": part, "whole": whole, "rows": self.count, "low": self.low, "high": self.high, "turns": self.turns, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "head": self.head, "tail": self.tail}
        if whole:
            ends = _all_chained([*self.blocks, {s: solve(self.rows, s) for s in STATES}])[0] if self.blocks else solve(self.rows)
            cost, audit = _best(ends)
            writer = _Writer(audit)
            for role, text, n in self.texts:
                for _ in range(n):
                    writer.row(role, text)
            return out | {"cost": cost, "audit": audit, "repaired_sha256": writer.digest(), "starts": None, "ends": None, "costs": None, "series": None}
        pairs = _all_chained([*self.blocks, {s: solve(self.rows, s) for s in STATES}])
        flat = [(s, e, cost, letters(digits, n)) for s, ends in pairs.items() for e, (cost, digits, n) in ends.items()]
        starts, ends, costs, series = map(list, zip(*flat))
        return out | {"cost": None, "audit": None, "repaired_sha256": None, "starts": starts, "ends": ends, "costs": costs, "series": series}


_COLUMN_NAMES = [c.split()[0] for c in _SEGMENT.split(", ")]
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("conv_id",)]
    + [("part", pa.int32()), ("whole", pa.bool_())]
    + [(c, pa.int64()) for c in ("rows", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal")]
    + [("head", pa.string()), ("tail", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    + [("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("series", pa.list_(pa.string()))]
)


def _segments(batches):
    """A record for each conversation of the task; the first and the last one may go on in other tasks."""
    part, now, first, done = TaskContext.get().partitionId(), None, True, []
    for batch in batches:
        for conv_id, turn, role, text, n, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fault"))):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.record(part, first))
                    first = False
                now = _Segment(conv_id)
            now.add(turn, role, text, n, fault)
        if len(done) >= 1024:
            yield pa.RecordBatch.from_pylist(done, _ARROW)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([*done, now.record(part, True)], _ARROW)


def _joined(segments: pd.DataFrame) -> pd.DataFrame:
    """The figures of one conversation from its segments: a few for each task that holds rows of it, whatever their number."""
    segments = segments.sort_values("part")
    total = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
    low = high = tail = None
    parts: list[Matrix] = []
    back = {c: str(d) for c, d in DIGITS.items()}
    for r in segments.to_dict("records"):
        if not r["rows"]:
            continue
        for c in total:
            total[c] += int(r[c])
        if tail is not None:
            total["illegal"] += tail + r["head"] not in ("su", "ua", "au")
        tail = r["tail"]
        if r["low"] is not None and not pd.isna(r["low"]):
            total["turns"] -= high == int(r["low"])
            low, high = int(r["low"]) if low is None else low, int(r["high"])
        matrix: Matrix = {}
        for s, e, cost, series in zip(r["starts"], r["ends"], r["costs"], r["series"]):
            matrix.setdefault(int(s), {})[int(e)] = (int(cost), int(series.translate(str.maketrans(back)) or "0", 8), len(series))
        parts.append(matrix)
    cost, audit = _best(_all_chained(parts)[0]) if parts else (0, "")
    gaps = high - low + 1 - total["turns"] if low is not None else 0
    return pd.DataFrame([{"conv_id": segments["conv_id"].iloc[0], "gaps": gaps, **{c: total[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}]).astype({"conv_id": "Int64"})


def _streamed(batches):
    """Digests: a conversation's audit comes first, then its rows in order."""
    key = writer = None
    ids, digests = [], []
    for batch in batches:
        for conv_id, audit, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "n"))):
            if audit is not None:
                if writer is not None:
                    ids.append(key)
                    digests.append(writer.digest())
                key, writer = conv_id, _Writer(audit)
            else:
                for _ in range(n):
                    writer.row(role, text)
    if writer is not None:
        ids.append(key)
        digests.append(writer.digest())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["of", "repaired_sha256"])


def repair(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text, n (how often the row is there; 0: only its conversation counts).

    A row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    counted, ranged = _faulted(rows)
    found = cut(ranged.mapInArrow(_segments, _SEGMENT), "segments")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
    whole = found.where("whole").select(*(gaps.cast("long").alias(c) if c == "gaps" else F.col(c) for c in _FIGURES))
    # the conversations at the ends of tasks: two for each task, and those with very long texts
    kinds = ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in _FIGURES[:-1])
    edges = cut(found.where("not whole").groupBy("conv_id").applyInPandas(_joined, kinds), "edges")
    wanted = edges.select(F.col("conv_id").alias("of"), "audit")
    texts = counted.join(wanted.select("of"), F.col("conv_id").eqNullSafe(F.col("of")), "left_semi").select("conv_id", F.lit(None).cast("string").alias("audit"), F.col("turn").isNotNull().alias("dated"), "turn", "role", "text", "n")
    heads = wanted.select(F.col("of").alias("conv_id"), "audit", F.lit(None).cast("boolean").alias("dated"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"))
    lines = texts.union(heads).repartition("conv_id").sortWithinPartitions("conv_id", "dated", "turn", "role", "text")
    digests = lines.mapInArrow(_streamed, "of long, repaired_sha256 string")
    return whole.union(edges.join(digests, F.col("conv_id").eqNullSafe(F.col("of"))).select(*_FIGURES))


def repaired_turns(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), role, text. rows and repaired: as of repair()."""

    def written(batches):
        writer = key = None
        at = 0
        out: list[tuple] = []

        class Lines(_Writer):
            def put(self, role, text):
                nonlocal at
                out.append((key, at, role, text))
                at += 1

        for batch in batches:
            for conv_id, audit, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "n"))):
                if audit is not None:
                    if writer is not None:
                        writer.inserts()
                    key, writer, at = conv_id, Lines(audit), 0
                else:
                    for _ in range(n):
                        writer.row(role, text)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "place", "role", "text"])
            out.clear()
        if writer is not None:
            writer.inserts()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "place", "role", "text"])

    texts = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n")).select("conv_id", F.lit(None).cast("string").alias("audit"), F.col("turn").isNotNull().alias("dated"), "turn", "role", "text", "n")
    heads = repaired.select("conv_id", "audit", F.lit(None).cast("boolean").alias("dated"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n"))
    lines = texts.union(heads).repartition("conv_id").sortWithinPartitions("conv_id", "dated", "turn", "role", "text")
    return lines.mapInArrow(written, "conv_id long, place long, role string, text string")
