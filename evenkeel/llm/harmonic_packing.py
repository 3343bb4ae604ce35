"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces longer than C/(k+1) and at most C/k, and a
bin of class k takes exactly k of them. Every task fills the bins of its own rows, so there is no shuffle, no
state beyond the open bins (under C tokens for each class) and a lost executor repeats its own tasks only.

A document is cut where a whole piece would fill its class badly: pieces of exactly C // k are split off until
what remains fills its class to at least 1 - `slack`. What the open bins of a task hold at its end is laid end to
end and cut at C; the last sequence is cut into lengths that are powers of two, which need no padding.

Results that are defined: a null text is an empty one; an empty text is the end id alone; repeated rows are packed
once for each; a null doc_id stays null; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY, SLACK, END_ID = 2048, 1 / 64, 1
#: Rows for each task have this share of the sequence ids.
_IDS_EACH = 1 << 36
#: Text outside these ranges, text with special tokens, and text with long white space, on which the faster library
#: backtracks until its stack is full, goes through the tokenizer's own splitter.
_LONG_SPACE = re.compile(r"\s{1024}")
_RARE = re.compile("[^\x00-ɏ‐-‧‰-⁞₠-₿←-⋿─-◿一-鿿]")


def cut_lengths(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """(length, class) of the pieces of n tokens, in order."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k * rest >= (1 - slack) * capacity:
            pieces.append((rest, k))
            break
        size = capacity // (k + 1)
        pieces.append((size, capacity // size))
        rest -= size
    return pieces


def tokenizer(json_path: str, ranks_path: str | None):
    """A function from text to uint32 ids. ranks_path: the same vocabulary as ranks, a faster way to the same ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(json_path)
    special = [t.content for t in plain.get_added_tokens_decoder().values()]

    def by_library(text: str) -> np.ndarray:
        return np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks_path is None:
        return by_library
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if _RARE.search(text) or _LONG_SPACE.search(text) or any(s in text for s in special):
            return by_library(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return ids


class _Packer:
    """The open bins of one task. Rows: id, start, ids, doc_tokens, class, sequence, offset."""

    def __init__(self, base: int, capacity: int, slack: float) -> None:
        self.capacity, self.slack, self.next, self.open, self.rows = capacity, slack, base, {}, []
        self.cuts: dict[int, list[tuple[int, int]]] = {}

    def add(self, doc, ids: np.ndarray) -> None:
        rest = len(ids) % self.capacity
        if rest not in self.cuts:
            self.cuts[rest] = cut_lengths(rest, self.capacity, self.slack)
        at = 0
        for length, k in [(self.capacity, 1)] * (len(ids) // self.capacity) + self.cuts[rest]:
            held = self.open.setdefault(k, [])
            held.append((doc, at, ids[at : at + length], len(ids)))
            at += length
            if len(held) == k:
                self.close(held, k)
                del self.open[k]

    def close(self, pieces: list, k: int) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            self.rows.append((doc, start, ids, n, k, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Class 0: what was left over, end to end."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) for p in left)
        rooms = [self.capacity] * (total // self.capacity) + [1 << b for b in range(total.bit_length(), -1, -1) if (total % self.capacity) >> b & 1]
        held: list = []
        room = iter(rooms)
        free = next(room, 0)
        for doc, start, ids, n in left:
            while len(ids):
                part, ids = ids[:free], ids[free:]
                held.append((doc, start, part, n))
                start += len(part)
                free -= len(part)
                if not free:
                    self.close(held, 0)
                    held, free = [], next(room, 0)


def pack(
    docs: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    slack: float = SLACK,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents, packed: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, size_class, sequence_id, offset.

    capacity has to be a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity has to be a power of two")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(n, long) for n in ("start", "length")] + [T.StructField("ids", T.BinaryType())] + [T.StructField(n, long) for n in ("doc_tokens", "size_class", "sequence_id", "offset")])

    def run(batches):
        to_ids = tokenizer(json_path, ranks_path)
        packer = _Packer(TaskContext.get().partitionId() * _IDS_EACH, capacity, slack)
        arrow: list = []

        def flush():
            out, packer.rows = packer.rows, []
            docs_, starts, ids, ns, ks, seqs, offsets = zip(*out)
            ids = [x.astype("<u4").tobytes() for x in ids]
            return pa.RecordBatch.from_arrays([pa.array(docs_, arrow[0]), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), *(pa.array(c, pa.int64()) for c in (ns, ks, seqs, offsets))], names=schema.names)

        for batch in batches:
            arrow[:] = [batch.column(0).type]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                packer.add(doc, np.append(to_ids(text), np.uint32(end_id)))
                if len(packer.rows) >= 8192:
                    yield flush()
        packer.finish()
        if packer.rows:
            yield flush()

    return rows.mapInArrow(run, schema)
