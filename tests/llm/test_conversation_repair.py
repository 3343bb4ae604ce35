import hashlib
import itertools
import random
import re
import zlib

import pytest

from evenkeel.llm import conversation_repair as cr
from evenkeel.llm import queries

WHITE = " \t\n\x0b\f\r"


def damage(rows):
    """The contract, row by row."""
    out, convs = [], []
    for conv, turn, role, text in rows:
        convs.append(conv)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(key.encode()) % 20
        if hit == 0:
            continue
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if hit == 3 else 1)
    return out, set(convs)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """Cost and audit by plain tuples: every (row, state) keeps its best (cost, letters), inserts one at a time."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserts(best):
        todo = dict(best)
        while todo:
            step = {}
            for state, (cost, audit) in todo.items():
                for c in "ua":
                    to = legal.get((state, c))
                    found = (cost + 2, audit + "I")
                    if to and found < best.get(to, (10**9, "")):
                        best[to] = step[to] = found
            todo = step
        return best

    best = inserts({"": (0, "")})
    for (_, _, role, _), kind in zip(rows, kinds):
        step = {}

        def reach(state, found, step=step):
            if state and found < step.get(state[0], (10**9, "")):
                step[state[0]] = found

        for state, (cost, audit) in best.items():
            reach([state], (cost + 3, audit + "D"))
            if kind not in ("blank", "duplicate"):
                late = kind == "truncated"
                reach([legal[state, role[:1]]] if (state, role[:1]) in legal else None, (cost + late, audit + "K"))
                for c in "ua":
                    reach([legal[state, c]] if (state, c) in legal else None, (cost + 2 + late, audit + "R"))
        best = inserts(step)
    return min(best[s] for s in ("", "a") if s in best)


def exhaustive(rows, kinds):
    """All series of edits, with at most two inserts at each place."""
    found = []
    gaps = [x for n in range(3) for x in itertools.product("ua", repeat=n)]

    def go(i, cost, audit, roles):
        for extra in gaps:
            c, a, r = cost + 2 * len(extra), audit + "I" * len(extra), roles + "".join(extra)
            if not re.fullmatch("(s?(ua)*u?)?", r):
                continue
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", r):
                    found.append((c, a))
                continue
            go(i + 1, c + 3, a + "D", r)
            if kinds[i] not in ("blank", "duplicate"):
                late = kinds[i] == "truncated"
                go(i + 1, c + late, a + "K", r + (rows[i][2][:1] or " "))
                for x in "ua":
                    go(i + 1, c + 2 + late, a + "R", r + x)

    go(0, 0, "", "")
    return min(found)


def rebuilt(rows, audit):
    turns = len(audit) - audit.count("D")
    initials = ("s" if turns % 2 else "") + "ua" * (turns // 2)
    out, i = [], 0
    for edit in audit:
        if edit != "D":
            role = {"u": "user", "a": "assistant"}.get(initials[len(out)])
            out.append((role, "") if edit == "I" else (rows[i][2] if edit == "K" else role, rows[i][3]))
        i += edit != "I"
    assert i == len(rows)
    return out


def expected(rows, solver=cheapest):
    left, convs = damage(rows)
    out = {}
    for conv in convs:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        kinds = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        cost, audit = solver(own, kinds)
        text = "\n".join(f"{r}:{t}" for r, t in rebuilt(own, audit))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def figures(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def made(seed, convs, most=9):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why?", " \t", "", None, "Well, well!", "é. ", "end.\n\n", "cut", "a.b"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "s", "User"]
    return [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{c} {i}{rng.choice('.!?x')}") for c in convs for i in range(rng.randrange(1, most))]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_brute_forces_agree():
    for seed in range(60):
        left, _ = damage(made(seed, [seed], 5))
        own = sorted(left, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        if len(own) < 6:
            assert cheapest(own, faults(own)) == exhaustive(own, faults(own))


@pytest.mark.parametrize("parts", [1, 4])
def test_small_conversations(spark, parts):
    rows = made(parts, [*range(-40, 120), None])
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'x' AS fault").repartition(parts)
    assert figures(cr.repair(cr.damaged(df))) == expected(rows)


def test_long_conversations_lie_in_many_tasks(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"t{t}.", "same.", "open", ""])) for c, n in ((1, 3000), (2, 700), (3, 2)) for t in range(n)]
    rows += [(4, 1, "user", "again and again.")] * 900 + [(5, None, "assistant", f"{i}.") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in (4, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert figures(cr.repair(cr.damaged(df))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_texts_are_not_held(spark, monkeypatch):
    monkeypatch.setattr(cr, "HELD_BYTES", 1000)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "x" * 400 + f"{t}.") for c in range(6) for t in range(6)] + [(9, 0, "user", "y" * 2_000_000)]
    seg = cr._Segment(1)
    for _, t, role, text in rows[:6]:
        seg.add(t, role, text, 1, 0)
    assert not seg.record(0, False)["whole"] and not seg.texts
    monkeypatch.undo()
    assert figures(cr.repair(cr.damaged(spark.createDataFrame(rows, SCHEMA)))) == expected(rows)


def test_blocks_chain_to_the_same_integers():
    rng = random.Random(3)
    for _ in range(30):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 40))]
        at = sorted(rng.sample(range(len(rows) + 1), min(3, len(rows))))
        blocks = [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)])]
        assert cr._all_chained([{s: cr.solve(b, s) for s in cr.STATES} for b in blocks])[0] == cr.solve(rows)


def test_repaired_turns(spark):
    rows = made(11, range(60))
    damaged = cr.damaged(spark.createDataFrame(rows, SCHEMA))
    repaired = cr.repair(damaged)
    turns = {}
    for r in cr.repaired_turns(damaged, repaired).collect():
        turns.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    for conv, found in figures(repaired).items():
        own = sorted(turns.get(conv, []))
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in own))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in own).encode()).hexdigest() == found[-1]


def test_empty_table(spark):
    assert figures(cr.repair(cr.damaged(spark.createDataFrame([], SCHEMA)))) == {}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = figures(queries.op11_integer_repair(spark, sf_dir))
    assert found == expected(rows)
    assert len({f[6] for f in found.values()}) > 5
