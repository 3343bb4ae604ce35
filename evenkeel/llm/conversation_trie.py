"""The prefix trie of conversations, with figures of every node.

A conversation is the path of its turns' tokens: 16 bytes of a SHA-256 of role and text, and 8 bytes that hold the text's length.
Paths are dealt out by ranges, so each task holds neighbours in sorted order, and a path that a third of all conversations share
lies in many tasks. In a task

1. equal paths become one entry; an edge joins each two neighbours at the depth of their longest common prefix;
2. edges are taken in descending depth; each joins two components of a union-find, and the node at that depth is where they
   branch. What lies deeper in a component is final then, as both edges beside it are at most as deep: its nodes are
   returned, a chain without branches in one go, and their sums go to the node where it joined.

Components that reach the first or the last entry of a task may go on in another one. Of these only the nodes that got sums are
returned, as entries whose path is the node's prefix: the forest contracted to what is open, a few entries for each task.
They are entries of the next round, with fewer tasks, until one round closes everything.

Results that are defined: a null role or text is empty, null turns come first, turns of one number stand by their token; conversations without
an id are left out; a conversation without turns ends at the root; an empty table gives no rows; other columns
are ignored. A conversation's tokens (24 bytes a turn) have to fit one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import cut

TOKEN = 24
#: Open entries that one task closes; with more there is another round.
LAST_ROUND = 50_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
_SUMS = ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_FOREST = "kind string, path binary, key binary, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, depth long, parent_conv_id long, parent_key binary, ends string"
_ARROW = pa.schema([(n, {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[t]) for n, t in (c.split() for c in _FOREST.split(", "))])


# ---------------------------------------------------------------- paths


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, tokens (hexadecimal texts in the order of the turns)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    token = F.concat(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32), F.lpad(F.hex(F.octet_length(text)), 16, "0"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull(), F.col("turn").cast("long"), token.alias("token")).alias("at"))
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["token"]).alias("tokens"))


def rebuilt(own: DataFrame) -> DataFrame:
    """The contract's conversations: the first h turns of conversation c - c % 5, then c's own after its first h; h = crc32(c) % 9."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    # h is 8 at most
    heads = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("tokens", 1, 8).alias("head"))
    none = F.array().cast("array<string>")
    met = own.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % 5 == F.col("base"), "left")
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("tokens", F.col("h") + 1, F.greatest(F.size("tokens") - F.col("h"), F.lit(0)))
    return met.select("conv_id", F.concat(head, rest).alias("tokens"))


# ---------------------------------------------------------------- forests of tasks


def _common(a: bytes, b: bytes) -> int:
    """Tokens that both paths begin with."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // TOKEN
    at = 0
    while a[at : at + TOKEN] == b[at : at + TOKEN]:
        at += TOKEN
    return at // TOKEN


def _key(path: bytes) -> bytes:
    return hashlib.sha256(path).digest()


class _Component:
    """Neighbouring entries lo to hi that share their first `depth` tokens; the sums are those of the node there."""

    __slots__ = ("lo", "hi", "depth", "least", "convs", "children", "leaves", "saved", "waiting", "own")

    def __init__(self, at: int, depth: int, least, convs: int, children: int, leaves: int, saved: int):
        self.lo = self.hi = at
        self.depth, self.least, self.convs, self.children, self.leaves, self.saved = depth, least, convs, children, leaves, saved
        #: Returned nodes that wait for their parent's least member; the entry that ends here.
        self.waiting: list[dict] = []
        self.own: int | None = at


class _Forest:
    """One task's entries. last: this task has all of them, so nothing stays open."""

    def __init__(self, entries: list[tuple], first_round: bool, last: bool):
        self.entries, self.first_round, self.last = entries, first_round, last
        self.out: list[dict] = []

    def grown(self) -> list[dict]:
        entries = self.entries
        n = len(entries)
        up = list(range(n))
        comps = [_Component(i, len(e[0]) // TOKEN, *e[1:6]) for i, e in enumerate(entries)]

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        depths = np.array([_common(entries[i - 1][0], entries[i][0]) for i in range(1, n)], np.int64)
        for edge in np.argsort(-depths, kind="stable").tolist():
            a, b = find(edge), find(edge + 1)
            comps[a] = self.merged(comps[a], comps[b], int(depths[edge]))
            comps[b] = None
            up[b] = a
        top = comps[find(0)]
        if self.last:
            self.closed(top, -1)
        else:
            self.opened(top)
        return self.out

    def is_open(self, c: _Component) -> bool:
        return not self.last and (c.lo == 0 or c.hi == len(self.entries) - 1)

    def merged(self, a: _Component, b: _Component, depth: int) -> _Component:
        node = _Component(a.lo, depth, None, 0, 0, 0, 0)
        node.hi, node.own = b.hi, None
        for c in (a, b):
            if c.depth == depth:
                children, leaves, saved, waiting = c.children, c.leaves, c.saved, c.waiting
                node.own = c.own if c.own is not None else node.own
            elif self.is_open(c):
                self.opened(c)
                continue
            else:
                row, leaves, saved = self.closed(c, depth)
                children, waiting = 1, [row]
            node.convs += c.convs
            node.children += children
            node.leaves += leaves
            node.saved += saved
            node.least = c.least if node.least is None else node.least if c.least is None else min(c.least, node.least)
            # the longer list takes the shorter one
            node.waiting, waiting = (node.waiting, waiting) if len(node.waiting) >= len(waiting) else (waiting, node.waiting)
            node.waiting.extend(waiting)
        return node

    def closed(self, c: _Component, depth: int) -> tuple[dict, int, int]:
        """Return the nodes of a final component below a depth. What the node there gets: its child, leaves and saved tokens."""
        path = self.entries[c.lo][0]
        leaves, saved, children = c.leaves if c.children else 1, c.saved, c.children
        for row in c.waiting:
            row["parent_conv_id"] = c.least
        row = None
        for at in range(c.depth, depth, -1):
            saved += (c.convs - 1) * int.from_bytes(path[TOKEN * at - 8 : TOKEN * at], "big") if at else 0
            ends, key = NO_ENDS, None
            if row is None:
                if self.first_round:
                    ends = self.entries[c.own][6].hexdigest() if c.own is not None else NO_ENDS
                elif c.own is not None:
                    ends, key = None, _key(path[: TOKEN * at])
            else:
                row["parent_conv_id"] = c.least
            row = {"kind": "node", "key": key, "conv_id": c.least, "depth": at, "n_convs": c.convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends": ends, "parent_conv_id": None}
            self.out.append(row)
            children = 1
        return row, leaves, saved

    def opened(self, c: _Component) -> None:
        """Return the sums of a node that may go on in other tasks as an entry of the next round."""
        if not c.convs:
            return
        path = self.entries[c.lo][0][: TOKEN * c.depth]
        key = _key(path)
        for row in c.waiting:
            row["parent_key"] = key
        self.out.append({"kind": "open", "path": path, "conv_id": c.least, "n_convs": c.convs, "n_children": c.children, "n_leaves": c.leaves, "saved_tokens": c.saved})
        if self.first_round and c.own is not None:
            ids = self.entries[c.own][7]
            self.out.append({"kind": "ends", "key": key, "conv_id": ids[0], "ends": ",".join(map(str, ids))})


def _forests(first_round: bool, last: bool):
    def run(batches):
        entries: list[list] = []
        for batch in batches:
            for path, *sums in zip(*(batch.column(c).to_pylist() for c in ("path", *_SUMS))):
                if entries and entries[-1][0] == path:
                    held = entries[-1]
                    held[1] = min(held[1], sums[0])
                    for i in range(1, 5):
                        held[i + 1] += sums[i]
                else:
                    entries.append([path, *sums, None, None])
                    if first_round:
                        entries[-1][6:] = [hashlib.sha256(), []]
                if first_round:
                    sha, ids = entries[-1][6:]
                    sha.update((b"," if ids else b"") + str(sums[0]).encode())
                    ids.append(sums[0])
        if entries:
            rows = _Forest(entries, first_round, last).grown()
            for at in range(0, len(rows), 8192):
                yield pa.RecordBatch.from_pylist(rows[at : at + 8192], _ARROW)

    return run


def _ends(batches):
    """Digests of identifiers whose sorted pieces come in order, a piece for each task that held some."""
    key, sha, keys, found = None, None, [], []
    for batch in batches:
        for own, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if own != key:
                if sha is not None:
                    keys.append(key)
                    found.append(sha.hexdigest())
                key, sha = own, hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
    if sha is not None:
        keys.append(key)
        found.append(sha.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["of", "digest"])


def trie(tokens: DataFrame) -> DataFrame:
    """tokens: conv_id, tokens (as of paths()). A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    entries = tokens.select(F.unhex(F.array_join("tokens", "")).alias("path"), "conv_id", F.lit(1).cast("long").alias("n_convs"), *(F.lit(0).cast("long").alias(c) for c in _SUMS[2:]))
    found = cut(entries.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_forests(True, False), _FOREST), "forests")
    rounds, left = [found], found.where("kind = 'open'").count()
    while left > LAST_ROUND:
        again = rounds[-1].where("kind = 'open'").select("path", *_SUMS).repartitionByRange(-(-2 * left // LAST_ROUND), "path").sortWithinPartitions("path")
        rounds.append(cut(again.mapInArrow(_forests(False, False), _FOREST), "forests"))
        before, left = left, rounds[-1].where("kind = 'open'").count()
        if left > before / 2:
            break  # spines that are nearly all branches: they are closed in one task
    rounds.append(cut(rounds[-1].where("kind = 'open'").select("path", *_SUMS).repartition(1).sortWithinPartitions("path").mapInArrow(_forests(False, True), _FOREST), "forests"))

    columns = ["conv_id", "depth", "parent_conv_id", "parent_key", *_SUMS[1:]]
    later = rounds[1].where("kind = 'node'")
    for more in rounds[2:]:
        later = later.union(more.where("kind = 'node'"))
    digests = found.where("kind = 'ends'").select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_ends, "of binary, digest string")
    keyed = later.where("key is not null").join(digests, F.col("key") == F.col("of"), "left").select(*columns, F.coalesce("digest", F.lit(NO_ENDS)).alias("ends_sha256"))
    rest = found.where("kind = 'node'").union(later.where("key is null")).select(*columns, F.col("ends").alias("ends_sha256"))
    nodes = keyed.union(rest)
    parents = later.where("key is not null").select("key", F.col("conv_id").alias("least"))
    waiting = nodes.where("parent_key is not null").join(parents, F.col("parent_key") == F.col("key")).withColumn("parent_conv_id", F.col("least"))
    result = ["conv_id", "depth", "parent_conv_id", *_SUMS[1:], "ends_sha256"]
    return nodes.where("parent_key is null").select(*result).union(waiting.select(*result))
