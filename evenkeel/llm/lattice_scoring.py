"""Language-model scores by subword lattices.

A word is a path through a lattice of arcs of three sizes, and its probability is the sum over all paths, in log space:

1. pieces of an existing vocabulary: one that begins with a space, then others, then a stop. Any byte can stand alone, so every
   stem can be spelled. All segmentations count, by a forward recursion.
2. a whole stem, where training words have it: a word without the ASCII punctuation at its end, which is spelled byte by byte,
   each by the one before it.
3. a whole word, where training texts have it.

Arcs of a size get (c - D(c)) / N of their counts (modified Kneser-Ney: discounts for 1, 2 and 3 or more from the counts of counts;
a stem counts once for each of its distinct words), and what D frees goes to the arcs of the next smaller size. So what is
gathered grows with the corpus, and a word never seen is carried by its stem and pieces.

A text's probability is the product over its words and the end, summed over classes of text (say, languages) that have weights of
their own. The class is never read when scoring. Each sequence of choices spells one text, so the probabilities of all texts
sum to at most 1.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased.

The vocabulary is not trained. The file at hand holds merge ranks and no probabilities, so the pieces' weights are fitted
by expectation maximisation over all segmentations of the distinct stems of all training texts, in tasks that return one
row for each class and piece.

Words are counted over all texts (partial counts in each task, then a shuffle on the word), and meet their stems in a shuffle join.
The HEAD most frequent words, a fixed number, are broadcast; all others meet their counts and scores in a shuffle join, in
which no word is frequent.

Results that are defined: a null text is an empty one, with the end as its only token; a null id counts as a training row;
repeated rows are scored each and counted each; an empty table gives no rows; without training texts all words are
unknown and pieces equally likely; a null class is a class; all classes take part: of more than MOST_CLASSES the most frequent
ones keep weights of their own, and the others, dealt by a hash, share SHARED weights; other columns are ignored.
"""

from __future__ import annotations

from math import exp, log, log1p, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import cut, discard, distinct_words, text_groups

HEAD, ROUNDS, SMOOTHING = 1 << 17, 4, 0.05
#: A word has a count and a score for each class. With more classes, so many weights are shared by the less frequent ones.
MOST_CLASSES, SHARED = 128, 32
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LONG = 192  # bytes; longer words are segmented one by one


def vocabulary(model_path: str) -> list[bytes]:
    """Pieces of a sentencepiece file that can occur in a lower-cased word, as bytes with a space for the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = set()
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if piece == piece.lower() and b" " not in piece[1:]:
                found.add(piece)
    return sorted(found)


class Lattice:
    """Segmentations into pieces 0..P-1 or single bytes P..P+255; P+256 is a word's stop."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = len(pieces) + 257
        self.bytes_at, self.stop = len(pieces), len(pieces) + 256
        self.initial = np.array([p[:1] == b" " for p in pieces] + [b == 32 for b in range(256)] + [False])
        used = sorted({b for p in pieces for b in p})
        self.column = np.zeros(256, np.int64)
        self.column[used] = np.arange(1, len(used) + 1)
        self.children: dict[int, int] = {}
        named = [-1]
        for i, piece in enumerate(pieces):
            node = 0
            for b in piece:
                step = node << 8 | b
                if step not in self.children:
                    self.children[step] = len(named)
                    named.append(-1)
                node = self.children[step]
            named[node] = i
        self.named = np.array(named, np.int64)
        self.next = np.full((len(named), len(used) + 1), -1, np.int32)
        for step, node in self.children.items():
            self.next[step >> 8, self.column[step & 255]] = node

    def _edges(self, letters: np.ndarray):
        """(start, length, rows, pieces) of words of one length, by start."""
        n, length = letters.shape
        columns = self.column[letters]
        everyone = np.arange(n)
        for i in range(length):
            yield i, 1, everyone, self.bytes_at + letters[:, i].astype(np.int64)
            rows, node = everyone, np.zeros(n, np.int64)
            for k in range(1, length - i + 1):
                node = self.next[node, columns[rows, i + k - 1]]
                on = node >= 0
                if not on.any():
                    break
                rows, node = rows[on], node[on]
                piece = self.named[node]
                is_piece = piece >= 0
                if is_piece.any():
                    yield i, k, rows[is_piece], piece[is_piece]

    def score(self, words: list[bytes], logp: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities of the words; with weights, instead the expected counts of pieces."""
        out = np.zeros(len(words))
        total = np.zeros(self.size)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word) + 1, []).append(i)
        for length, chosen in by_length.items():
            if length > _LONG:
                for i in chosen:
                    out[i] = self._one(b" " + words[i], logp, total, None if weights is None else weights[i])
                continue
            for at in range(0, len(chosen), 8192):
                part = np.array(chosen[at : at + 8192])
                letters = np.frombuffer(b"".join(b" " + words[i] for i in part), np.uint8).reshape(len(part), length)
                forward = np.full((length + 1, len(part)), -np.inf)
                forward[0] = 0
                edges = self._edges(letters)
                if weights is not None:
                    edges = list(edges)
                for i, k, rows, piece in edges:
                    forward[i + k, rows] = np.logaddexp(forward[i + k, rows], forward[i, rows] + logp[piece])
                out[part] = forward[length] + logp[self.stop]
                if weights is not None:
                    backward = np.full((length + 1, len(part)), -np.inf)
                    backward[length] = np.log(weights[part]) - forward[length]
                    shares = []
                    for i, k, rows, piece in reversed(edges):
                        through = backward[i + k, rows] + logp[piece]
                        backward[i, rows] = np.logaddexp(backward[i, rows], through)
                        shares.append(through + forward[i, rows])
                    total += np.bincount(np.concatenate([e[3] for e in reversed(edges)]), np.exp(np.concatenate(shares)), self.size)
        return out if weights is None else total

    def _one(self, word: bytes, logp: np.ndarray, total: np.ndarray, weight: float | None) -> float:
        named, children = self.named, self.children
        forward = [-np.inf] * (len(word) + 1)
        forward[0] = 0.0
        edges = []
        for i, b in enumerate(word):
            out = [(1, self.bytes_at + b)]
            node = 0
            for k in range(1, len(word) - i + 1):
                node = children.get(node << 8 | word[i + k - 1], -1)
                if node < 0:
                    break
                if named[node] >= 0:
                    out.append((k, int(named[node])))
            for k, piece in out:
                x, y = forward[i + k], forward[i] + logp[piece]
                forward[i + k] = max(x, y) + log1p(exp(-abs(x - y))) if x > -np.inf else y
            edges.append(out)
        if weight is not None:
            backward = [-np.inf] * len(word) + [log(weight) - forward[-1]]
            for i in range(len(word) - 1, -1, -1):
                for k, piece in edges[i]:
                    y = backward[i + k] + logp[piece]
                    x = backward[i]
                    backward[i] = max(x, y) + log1p(exp(-abs(x - y))) if x > -np.inf else y
                    total[piece] += exp(y + forward[i])
        return forward[-1] + logp[self.stop]

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """Log probabilities from counts: pieces with a space sum to 1, the others and the stop too."""
        first, rest = np.where(self.initial, counts, 0), np.where(self.initial, 0, counts)
        return np.log(np.where(self.initial, counts / first.sum(), counts / rest.sum()))


_BUILT: dict[int, Lattice] = {}


def _lattice(pieces: list[bytes]) -> Lattice:
    """One for each Python worker."""
    key = hash(tuple(pieces))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Lattice(pieces)
    return _BUILT[key]


def held_out_by(id_col: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == rest, F.lit(False))


def _counting(classes: int):
    """Partial counts of words: in all texts, and in the training texts of each class."""

    def run(batches):
        for batch in batches:
            texts, numbers = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for begin, end in text_groups(texts, 6_000_000 // max(classes, 4)):
                buffer, starts, ends, place, begins = distinct_words(texts[begin:end])
                which = np.repeat(numbers[begin:end], np.diff(begins))
                counts = np.bincount(place * (classes + 1) + which, minlength=len(starts) * (classes + 1)).reshape(-1, classes + 1)
                yield pa.RecordBatch.from_arrays([pa.array(_spans(buffer, starts, ends), pa.binary()), pa.array(counts.sum(axis=1)), *(pa.array(c) for c in counts.T[:classes].copy())], names=["word", "uses", *(f"c{i}" for i in range(classes))])

    return run


def _spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = buffer.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _joined(batches, rows: int = 1 << 17):
    """Larger tables out of batches: words of a length are segmented together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def fit(stems: DataFrame, classes: int, pieces: list[bytes], rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log probabilities (classes x pieces) from the distinct stems of each class: stem, k0, k1, ..."""
    lattice = Lattice(pieces)
    logp = np.array([lattice.weights(np.ones(lattice.size))] * classes)
    rows = stems.select(F.col("stem").cast("binary"), *(F.col(f"k{i}") > 0 for i in range(classes)))
    for _ in range(rounds):

        def expect(batches, logp=logp):
            own = _lattice(pieces)
            total = np.zeros((classes, own.size))
            for batch in _joined(batches):
                named = np.array([*batch.column(0).to_pylist(), None], object)[:-1]
                for i in range(classes):
                    chosen = named[batch.column(i + 1).to_numpy(zero_copy_only=False).astype(bool)]
                    if len(chosen):
                        total[i] += own.score(chosen.tolist(), logp[i], np.ones(len(chosen)))
                        total[i, own.stop] += len(chosen)
            i, piece = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[i, piece])], names=["i", "piece", "n"])

        found = rows.mapInArrow(expect, "i int, piece int, n double").groupBy("i", "piece").agg(F.sum("n").alias("n")).collect()  # a row for each class and piece at most
        counts = np.full(logp.shape, smoothing)
        for r in found:
            counts[r.i, r.piece] += r.n
        logp = np.array([lattice.weights(c) for c in counts])
    return logp


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """D(0) to D(3 and more) from the numbers of arcs that have a count of 1, 2, 3 and 4."""
    n1, n2, n3, n4 = np.maximum(of_counts.astype(float), 1.0)
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.1, [0.95, 1.95, 2.95])])


class Level:
    """Arcs of one size: the log probability of counts, and that of all smaller arcs together, by class."""

    def __init__(self, row, names: list[str]) -> None:
        self.total = np.array([row[f"t{x}"] or 0 for x in names], float)
        self.discount = np.array([discounts(np.array([row[f"n{k}{x}"] for k in (1, 2, 3, 4)])) for x in names])
        freed = np.array([[row[f"n1{x}"], row[f"n2{x}"], row[f"v{x}"] - row[f"n1{x}"] - row[f"n2{x}"]] for x in names], float)
        self.freed = np.maximum((freed * self.discount[:, 1:]).sum(axis=1), 1e-9)

    @staticmethod
    def figures(names: list[str]) -> list[Column]:
        each = [F.count(F.when(F.col(x) == k, 1)).alias(f"n{k}{x}") for x in names for k in (1, 2, 3, 4)]
        return [*each, *(F.sum(x).alias(f"t{x}") for x in names), *(F.count(F.when(F.col(x) > 0, 1)).alias(f"v{x}") for x in names)]

    def join(self, i: int, counts: np.ndarray, smaller: np.ndarray, total: float) -> np.ndarray:
        """log of an arc's own share, or else of a path of smaller arcs."""
        own = counts - self.discount[i][np.minimum(counts, 3)]
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(own / total), log(self.freed[i] / total) + smaller)


def tail_weights(words: DataFrame, classes: int) -> np.ndarray:
    """log p(next | last, class) of the bytes of tails: classes x 256 x 256, where 0 is a tail's begin and its end. From distinct words."""
    own = F.transform(F.filter(F.split("tail", ""), lambda x: x != ""), F.ascii)
    edge = F.array(F.lit(0))
    steps = F.arrays_zip(F.concat(edge, own).alias("last"), F.concat(own, edge).alias("next"))
    rows = words.select(*(F.col(f"c{i}") for i in range(classes)), F.explode(steps).alias("x"))
    found = rows.groupBy("x.last", "x.next").agg(*(F.count_if(F.col(f"c{i}") > 0).alias(f"c{i}") for i in range(classes))).collect()  # 33 * 33 rows at most
    symbols = np.array([0, *PUNCTUATION.encode()])
    counts = np.zeros((classes, 256, 256))
    counts[:, symbols[:, None], symbols] = 0.05
    for r in found:
        counts[:, r.last, r.next] += [r[f"c{i}"] for i in range(classes)]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log(counts / counts.sum(axis=2, keepdims=True))


def tail_scores(tails: list[bytes], weights: np.ndarray) -> np.ndarray:
    """tails x classes."""
    known: dict[bytes, np.ndarray] = {}
    for tail in set(tails):
        codes = np.frombuffer(b"\0" + tail + b"\0", np.uint8)
        known[tail] = weights[:, codes[:-1], codes[1:]].sum(axis=1)
    return np.array([known[t] for t in tails]).reshape(len(tails), weights.shape[0])


def _numbered(rows: DataFrame) -> tuple[int, Column]:
    """How many weights the training rows' classes (kind) have, and the number of a row's."""
    training = rows.where(~F.col("held_out"))
    kinds = [r.kind for r in training.select("kind").distinct().orderBy("kind").limit(MOST_CLASSES + 1).collect()]
    most = len(kinds) > MOST_CLASSES
    if most:
        own = training.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(MOST_CLASSES - SHARED)
        kinds = [r.kind for r in own.collect()]
    number = len(kinds) + F.pmod(F.xxhash64("kind"), F.lit(SHARED)).cast("int") if most else F.lit(0)
    for i, k in enumerate(kinds):
        number = F.when(F.col("kind").eqNullSafe(F.lit(k).cast("string")), i).otherwise(number)
    if not most:
        return len(kinds), number
    # a shared weight that no class falls to isn't there
    found = sorted(r.number for r in training.select(number.alias("number")).distinct().collect())
    compact = {raw: i for i, raw in enumerate(found)}
    return len(found), F.element_at(F.array(*(F.lit(compact.get(raw, 0)) for raw in range(MOST_CLASSES))), number + 1)


def score(
    docs: DataFrame,
    held_out: Column,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    class_col: str | None = None,
    head: int = HEAD,
    rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words with add-one counts), score; both are log10."""
    spark = docs.sparkSession
    kind = F.col(class_col).cast("string") if class_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"), kind.alias("kind"))
    pieces = vocabulary(model_path)
    learned, number = _numbered(rows)
    classes = max(learned, 1)
    numbered = rows.select("text", F.when(F.col("held_out"), classes).otherwise(number).alias("number"))
    c, k = [f"c{i}" for i in range(classes)], [f"k{i}" for i in range(classes)]
    words = numbered.mapInArrow(_counting(classes), "word binary, uses long, " + ", ".join(f"{x} long" for x in c)).groupBy("word").agg(*(F.sum(x).alias(x) for x in ("uses", *c)))
    stem = F.rtrim(F.col("word").cast("string"), F.lit(PUNCTUATION))
    words = cut(words.select("*", stem.alias("stem"), F.substring(F.col("word").cast("string"), F.length(stem) + 1, F.length("word")).alias("tail")), "words")
    ends_of = {r.number: r.n for r in numbered.groupBy("number").agg(F.count("*").alias("n")).collect()}
    ends = np.array([ends_of.get(i, 0) for i in range(classes)], float)
    stats = words.agg(F.count(F.when(sum(F.col(x) for x in c) > 0, 1)).alias("v"), *Level.figures(c)).first()
    of_words = Level(stats, c)
    tokens = of_words.total + ends
    n, v = int(tokens.sum()), stats.v + bool(ends.sum())
    stems = cut(words.groupBy("stem").agg(*(F.count_if(F.col(x) > 0).alias(y) for x, y in zip(c, k))), "stems")
    of_stems = Level(stems.agg(*Level.figures(k)).first(), k)
    logp = fit(stems, classes, pieces, rounds if learned else 0)
    tails = tail_weights(words, classes)
    if not learned:
        tokens, ends, of_words.freed, of_stems.total, of_stems.freed = (np.full(1, x) for x in (1.0, 0.5, 0.5, 1.0, 1.0))
    stem_total = np.maximum(of_stems.total, of_stems.freed)
    share = np.log10(ends / ends.sum())
    s = [f"s{i}" for i in range(classes)]

    def spelling(batches):
        """Stems with their log probabilities, as an arc or by pieces."""
        lattice = _lattice(pieces)
        for batch in _joined(batches):
            named = batch.column(0).to_pylist()
            found = [of_stems.join(i, batch.column(1 + i).to_numpy(), lattice.score(named, logp[i]), stem_total[i]) for i in range(classes)]
            yield from pa.table([batch.column(0), *map(pa.array, found)], names=["stem", *s]).to_batches(1 << 14)

    def scoring(batches):
        """Words with their log10 probabilities, as an arc or by stem and tail."""
        for batch in batches:
            ending = tail_scores(batch.column(2).to_pylist(), tails)
            counts = [batch.column(3 + i).to_numpy() for i in range(classes)]
            found = [of_words.join(i, counts[i], batch.column(3 + classes + i).to_numpy() + ending[:, i], tokens[i]) / log(10) for i in range(classes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sum(counts, axis=0)), *map(pa.array, found)], names=["word", "uses", "c", *s])

    doubles = ", ".join(f"{x} double" for x in s)
    spelled = cut(stems.select(F.col("stem").cast("binary").alias("stem"), *k).mapInArrow(spelling, f"stem binary, {doubles}"), "stem-scores")
    met = words.select("word", "uses", F.col("tail").cast("binary").alias("tail"), *c, F.col("stem").cast("binary").alias("stem")).join(spelled, "stem")
    scored = cut(met.select("word", "uses", "tail", *c, *s).mapInArrow(scoring, f"word binary, uses long, c long, {doubles}"), "scored-words")
    discard(words, stems, spelled)
    step = F.floor(F.log2("uses") * 64)
    level, room = 1 << 20, head
    for r in scored.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # 64 steps to a doubling
        room -= r.n
        if room < 0:
            break
        level = r.step
    top = scored.where(step >= level).collect()  # `head` rows at most
    table = np.array([[r.c, *(r[x] for x in s)] for r in top], float).reshape(len(top), 1 + len(s))
    frequent = spark.sparkContext.broadcast(({bytes(r.word): i for i, r in enumerate(top)}, table))
    least = log10(n + v + 1)
    start = np.array([log10(ends.sum() + 1) - least if n else -least, *(share + np.log10(ends / tokens))])
    known_end = int(n > 0)
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    fields = f"row long, doc_id {id_kind}, held_out boolean, n_tokens long, n_known long, base_score double, " + ", ".join(f"{x} double" for x in s) + ", word binary, times long"
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", *s, "word", "times"]

    def splitting(batches):
        """A row for each text with its frequent words summed, and a row for each other word of it."""
        place, values = frequent.value
        values = values.copy()
        known_words = values[:, 0] > 0
        values[:, 0] = np.log10(values[:, 0] + 1) - least
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in text_groups(texts):
                buffer, starts, stops, uses, begins = distinct_words(texts[begin:end])
                words = _spans(buffer, starts, stops)
                at = np.array([place.get(w, -1) for w in words], np.int64)[uses]
                own = np.repeat(np.arange(end - begin), np.diff(begins))
                common = at >= 0
                sums = np.tile(start, (end - begin, 1))
                for i in range(sums.shape[1]):
                    sums[:, i] += np.bincount(own[common], values[at[common], i], end - begin)
                known = np.bincount(own[common], known_words[at[common]], end - begin).astype(np.int64) + known_end
                size = end - begin
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(size)), batch.column(0).slice(begin, size), batch.column(2).slice(begin, size), pa.array(np.diff(begins) + 1), pa.array(known), *(pa.array(x) for x in sums.T.copy()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.int64())], names=names)
                pairs, times = np.unique(own[~common] * len(words) + uses[~common], return_counts=True)
                for i in range(0, len(pairs), 1 << 16):
                    which, word = np.divmod(pairs[i : i + (1 << 16)], len(words))
                    size = len(which)
                    yield pa.RecordBatch.from_arrays([pa.array(row + which), pa.nulls(size, batch.column(0).type), pa.nulls(size, pa.bool_()), *[pa.nulls(size, pa.int64())] * 2, *[pa.nulls(size, pa.float64())] * (1 + len(s)), pa.array([words[w] for w in word.tolist()], pa.binary()), pa.array(times[i : i + (1 << 16)])], names=names)
                row += end - begin

    parts = cut(rows.select("doc_id", "text", "held_out").mapInArrow(splitting, fields), "word-uses")
    rare = parts.where("word is not null").select("row", "word", "times").join(scored.drop("uses"), "word")
    rare = rare.select("row", F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("n_known"), (F.col("times") * (F.log10(F.col("c") + 1) - least)).alias("base_score"), *((F.col("times") * F.col(x)).alias(x) for x in s))
    both = parts.where("word is null").drop("word", "times").unionByName(rare, allowMissingColumns=True)
    done = both.groupBy("row").agg(*(F.max(x).alias(x) for x in ("doc_id", "held_out", "n_tokens")), *(F.sum(x).alias(x) for x in ("n_known", "base_score", *s)))
    best = F.greatest(*(F.col(x) for x in s)) if len(s) > 1 else F.col(s[0])
    total = best + F.log10(sum(F.pow(F.lit(10.0), F.col(x) - best) for x in s))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", total.alias("score"))
