"""Language identification of words in code-switched text by a linear-chain conditional random field.

Each word is an observation. Its features are the byte n-grams (2 to 4) of the lower-cased word between two spaces, so
those at the word's ends are its affixes, and membership in the lexicons of frequent words of each language. Weights of
features and of transitions between languages are learned together by gradients of the conditional log likelihood
(forward-backward); words are labelled by their marginals, again by forward-backward over the whole text. A text's language
has the largest mean marginal, which is its score.

The model is fitted on a sample of labelled rows with a fixed bound: `per_language` rows for each language, in the order of a hash,
of each longer text a window of `most_chars` characters, drawn by the hash among those with a letter. Every text is
labelled whole, and every label with a letter in a text is learned, whatever their number. As the cost of a word grows with the square of
the languages, many languages get smaller samples (sample_bounds) and smaller tables of n-grams (table_size), so that what
training takes and holds stays bounded. A very long text is labelled in pieces at once, with the same marginals. Scoring needs no shuffle:
the model (about 1 MB for each language up to 128, then 100 MB) goes to the tasks.

The CRF has to choose a learned language. With `evidence`, labelling also tells how far a text's words look like its language
at all: a word is recognised if most of its byte 4-grams are in two or more distinct sampled texts of that language; the
evidence is the share of recognised words over the median share in the language's sampled texts, so a small sample asks less.
Words without a letter and words of one byte can't tell and don't count; a text that has no others gets 1.

Results that are defined: `und` with score 0 for a text that is null or has no letter, and for all texts if there is no
labelled row; repeated rows are labelled each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import cut, distinct_words, span_hashes, text_groups

PER_LANGUAGE, MOST_CHARS, EPOCHS, LEXICON = 200, 20_000, 24, 400
#: Up to so many languages have whole tables of n-grams.
FULL_LANGUAGES = 128
#: Sampled words times the square of the languages; words times languages that training holds at once; a label's rows at least.
MOST_COST, HELD, LEAST_ROWS = 20_000_000_000, 1 << 24, 20
UNKNOWN = "und"
#: Texts of more words than PIECE are labelled in pieces that meet by exact messages, which cost the third power of the
#: languages; with more than MOST_SPLIT languages they go word by word instead.
PIECE, MOST_SPLIT = 2048, 32
_TABLE, _ORDERS = 1 << 16, (2, 3, 4)


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # orders x table x languages
    lexicon: np.ndarray  # sorted hashes of words
    member: np.ndarray  # lexicon x languages: 1 where the word is frequent
    lexical: np.ndarray  # languages x languages
    bias: np.ndarray
    moves: np.ndarray  # languages x languages
    seen: list[np.ndarray] = field(default_factory=list)  # for each language: sorted 4-grams of two or more of its texts
    usual: list[float] = field(default_factory=list)  # for each language: median share of recognised words in its texts


def table_size(languages: int) -> int:
    """Places of a table of n-grams: a power of two, so that all languages' tables stay within those of FULL_LANGUAGES."""
    return max(_TABLE >> max(0, -(-languages // FULL_LANGUAGES) - 1).bit_length(), 256)


def gram_codes(buffer: np.ndarray, size: int = _TABLE) -> list[np.ndarray]:
    """Table places of the n-grams that begin at each byte of a buffer in which spaces separate words."""
    x = buffer.astype(np.uint32)
    two = x[:-1] << np.uint32(8) | x[1:]
    three = two[:-1] << np.uint32(8) | x[2:]
    four = three[:-1] << np.uint32(8) | x[3:]
    spread = np.uint32(2654435761)
    if size < _TABLE:
        shift = np.uint32(33 - size.bit_length())
        return [(codes * spread >> shift).astype(np.int64) for codes in (two, three, four)]
    return [two.astype(np.int64), (three * spread >> np.uint32(16)).astype(np.int64), (four * spread >> np.uint32(16)).astype(np.int64)]


def spaced(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffer with every separator as a space and one more before and after; starts and ends in it."""
    inside = np.zeros(len(buffer) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    out = np.full(len(buffer) + 4, 32, np.uint8)
    out[1 : len(buffer) + 1] = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, buffer, 32)
    return out, starts + 1, ends + 1


def fours(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exact 4-grams of words between two spaces (a one-letter word has none), and the word of each."""
    text, first, last = spaced(buffer, starts, ends)
    x = text.astype(np.uint32)
    codes = x[:-3] << np.uint32(24) | x[1:-2] << np.uint32(16) | x[2:-1] << np.uint32(8) | x[3:]
    n = np.maximum(last - first - 1, 0)
    at = np.repeat(first - 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return codes[at], np.repeat(np.arange(len(starts)), n)


def recognised(seen: list[np.ndarray], buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """words x languages: whether two thirds of a word's 4-grams are among the language's."""
    codes, owner = fours(buffer, starts, ends)
    n = np.bincount(owner, minlength=len(starts))
    out = np.zeros((len(starts), len(seen)), bool)
    for i, known in enumerate(seen):
        if len(known):
            hit = known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes
            out[:, i] = (3 * np.bincount(owner, hit, len(starts)) >= 2 * n) & (n > 0)
    return out


def telling(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a (lowered) word has two or more bytes and a letter."""
    letters = np.concatenate(([0], np.cumsum((buffer >= 128) | ((buffer >= 97) & (buffer <= 122)))))
    return (ends - starts > 1) & (letters[ends] > letters[starts])


def learn_evidence(model: Model, texts: list[str], labels: list[str]) -> None:
    """Set seen and usual. Equal texts count once."""
    for language in model.languages:
        own = sorted({t for t, x in zip(texts, labels) if x == language})
        buffer, starts, ends, place, first = distinct_words(own)
        codes, owner = fours(buffer, starts, ends)
        begin = np.searchsorted(owner, np.arange(len(starts) + 1))
        of_texts = [np.unique(place[a:b]) for a, b in zip(first, first[1:])]
        found = [np.unique(np.concatenate([codes[begin[w] : begin[w + 1]] for w in some])) for some in of_texts if len(some)]
        grams, uses = np.unique(np.concatenate(found or [codes[:0]]), return_counts=True)
        model.seen.append(grams[uses >= min(2, len(own))])
        known = recognised(model.seen[-1:], buffer, starts, ends)[:, 0]
        tells = telling(buffer, starts, ends)
        shares = [known[some].mean() for a, b in zip(first, first[1:]) if len(some := place[a:b][tells[place[a:b]]])]
        model.usual.append(float(np.median(shares)) if shares else 0.0)


def lexicon_rows(model: Model, hashes: np.ndarray) -> np.ndarray:
    if not len(model.lexicon):
        return np.zeros((len(hashes), len(model.languages)), np.float32)
    at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
    return model.member[at] * (model.lexicon[at] == hashes)[:, None]


def emissions(model: Model, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """words x languages: sums of weights."""
    out = lexicon_rows(model, span_hashes(buffer, starts, ends)) @ model.lexical + model.bias
    text, first, last = spaced(buffer, starts, ends)
    for order, codes, table in zip(_ORDERS, gram_codes(text, model.grams.shape[1]), model.grams):
        total = np.zeros((len(codes) + 1, table.shape[1]))
        np.cumsum(table[codes], axis=0, dtype=np.float64, out=total[1:])
        out += total[np.maximum(last + 2 - order, first - 1)] - total[first - 1]
    return out


def _messages(seen: np.ndarray, step: np.ndarray, at: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces that texts are cut into (in order; heads: where one begins): what comes to each from before and from after.

    A piece is a product of its words' transfer matrices, one for each piece in a step; what passes on is a vector times those.
    """
    k = len(step)
    products = np.broadcast_to(np.eye(k, dtype=seen.dtype), (len(at), k, k)).copy()
    for t in range(sizes.max()):
        some = np.flatnonzero(sizes > t)
        words = seen[at[some] + t]
        move = np.broadcast_to(step, (len(some), k, k))
        if t == 0:
            move = np.where(heads[some, None, None], np.full((k, k), 1 / k, step.dtype), move)
        found = products[some] @ (move * words[:, None, :])
        products[some] = found / found.max(axis=(1, 2), keepdims=True)
    before, after = np.ones((2, len(at), k), seen.dtype)
    last = np.ones(k, seen.dtype)
    for i in range(len(at)):
        last = np.ones(k, seen.dtype) if heads[i] else last
        before[i] = 1 if heads[i] else last @ step
        last = last @ products[i]
        last /= last.sum()
    for i in range(len(at) - 1, 0, -1):
        if not heads[i]:
            after[i - 1] = products[i] @ after[i]
            after[i - 1] /= after[i - 1].sum()
    return before, after


def marginals(scores: np.ndarray, begins: np.ndarray, moves: np.ndarray, pairs: np.ndarray | None = None, piece: int = PIECE) -> np.ndarray:
    """P(language of word | text) of texts laid end to end; begins has an end. pairs: gets expected transitions added.

    All texts advance together, one word each step, longest first. Texts of more than `piece` words advance in pieces, which
    meet by exact messages; so a text of millions of words takes a few thousand steps.
    """
    k = scores.shape[1]
    at, sizes = begins[:-1], np.diff(begins)
    seen = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    step = np.exp(moves - moves.max())
    before = after = np.ones((len(at), k), seen.dtype)
    if pairs is None and k <= MOST_SPLIT and len(sizes) and sizes.max() > piece:
        n = np.maximum(-(-sizes // piece), 1)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own, size = np.repeat(at, n) + nth * piece, np.minimum(np.repeat(sizes, n) - nth * piece, piece)
        before, after = np.ones((2, len(own), k), seen.dtype)
        cut_up = np.repeat(n > 1, n)
        before[cut_up], after[cut_up] = _messages(seen, step, own[cut_up], size[cut_up], nth[cut_up] == 0)
        at, sizes = own, size
    order = np.argsort(-sizes, kind="stable")
    at, sizes, before, back = at[order], sizes[order], before[order], after[order].copy()
    live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, (sizes[0] if len(sizes) else 0) + 1))
    forward = np.empty_like(seen)
    for t, n in enumerate(live):
        i = at[:n] + t
        a = before[:n] * seen[i] if t == 0 else (a[:n] @ step) * seen[i]  # noqa: F821
        a /= a.sum(axis=1, keepdims=True)
        forward[i] = a
    for t in range(len(live) - 1, 0, -1):
        n = live[t]
        i = at[:n] + t
        onward = seen[i] * back[:n]
        onward /= onward.sum(axis=1, keepdims=True)
        if pairs is not None:
            earlier = forward[i - 1]
            pairs += step * ((earlier / ((earlier @ step) * onward).sum(axis=1, keepdims=True)).T @ onward)
        forward[i] *= back[:n]
        back[:n] = onward @ step.T
        back[:n] /= back[:n].sum(axis=1, keepdims=True)
    if len(live):
        forward[at[: live[0]]] *= back[: live[0]]
    if len(forward):
        forward /= forward.sum(axis=1, keepdims=True)
    return forward


class _Part:
    """Some of the sampled texts: their distinct words, and places of them."""

    def __init__(self, texts: list[str], truth: list[int]):
        self.buffer, self.starts, self.ends, self.place, self.first = distinct_words(texts)
        self.truth = np.repeat(np.array(truth, np.int64), np.diff(self.first))
        self.hashes = span_hashes(self.buffer, self.starts, self.ends)
        self.lexical: np.ndarray | None = None

    def grams(self, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order the table places of all words' n-grams, and the word of each."""
        text, s, e = spaced(self.buffer, self.starts, self.ends)
        out = []
        for order, codes in zip(_ORDERS, gram_codes(text, size)):
            n = np.maximum(e + 2 - order - (s - 1), 0)
            at = np.repeat(s - 1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((codes[at], np.repeat(np.arange(len(s)), n)))
        return out

    def emissions(self, model: Model) -> np.ndarray:
        return block_emissions(model, self.buffer, self.starts, self.ends)


def block_emissions(model: Model, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind=np.float64) -> np.ndarray:
    """emissions() of words that follow one another in the buffer, in blocks of bounded size."""
    k = len(model.languages)
    out = np.zeros((len(starts), k), kind)
    for i in range(0, len(starts), block := 50_000 // (max(k, 4) // 4)):
        a, b = starts[i : i + block], ends[i : i + block]
        out[i : i + block] = emissions(model, buffer[a[0] : b[-1]], a - a[0], b - a[0])
    return out


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, lexicon: int = LEXICON) -> Model:
    """Fit by full-batch Adam; every word of a text has the text's label. Texts are gone through in parts of bounded size."""
    languages = sorted(set(labels))
    k = len(languages)
    size = table_size(k)
    number = {x: i for i, x in enumerate(languages)}
    parts = [_Part(texts[a:b], [number[x] for x in labels[a:b]]) for a, b in text_groups(texts, HELD // k)]
    # a language's most frequent words
    every = np.unique(np.concatenate([p.hashes for p in parts]))
    uses = np.zeros((len(every), k), np.int32)
    for p in parts:
        np.add.at(uses, (np.searchsorted(every, p.hashes)[p.place], p.truth), 1)
    top = np.zeros(uses.shape, bool)
    for i in range(k):
        best = np.lexsort((every, -uses[:, i]))[:lexicon]
        top[best, i] = uses[best, i] > 1
    chosen = np.flatnonzero(top.any(axis=1))
    model = Model(languages, np.zeros((len(_ORDERS), size, k), np.float32), every[chosen], top[chosen].astype(np.float32), np.zeros((k, k)), np.zeros(k), np.zeros((k, k)))
    del uses, top, every
    stay = np.zeros((k, k))
    for p in parts:
        begun = p.first[:-1][np.diff(p.first) > 0]
        stay += np.diag(np.bincount(p.truth, minlength=k) - np.bincount(p.truth[begun], minlength=k))
    total = max(sum(len(p.truth) for p in parts), 1)
    kept = parts[0].grams(size) if len(parts) == 1 else None
    names = ("grams", "lexical", "bias", "moves")
    speed = {"grams": 0.15, "lexical": 0.1, "bias": 0.05, "moves": 0.2}
    mean, square = ({n: np.zeros(getattr(model, n).shape, np.float32 if n == "grams" else float) for n in names} for _ in range(2))
    for epoch in range(1, epochs + 1):
        pairs = np.zeros((k, k))
        slope = {"grams": np.zeros(model.grams.shape), "lexical": np.zeros((k, k)), "bias": np.zeros(k)}
        for p in parts:
            rest = -marginals(p.emissions(model)[p.place], p.first, model.moves, pairs)
            rest[np.arange(len(p.truth)), p.truth] += 1
            by_word = np.stack([np.bincount(p.place, rest[:, i], len(p.hashes)) for i in range(k)], axis=1)
            for order, (codes, owner) in enumerate(kept or p.grams(size)):
                for i in range(k):
                    slope["grams"][order, :, i] += np.bincount(codes, by_word[owner, i], size)
            slope["lexical"] += lexicon_rows(model, p.hashes).T @ by_word
            slope["bias"] += rest.sum(axis=0)
        slope["moves"] = stay - pairs
        for n in names:
            value = getattr(model, n)
            g = slope[n] / total - 1e-5 * value
            mean[n] = 0.9 * mean[n] + 0.1 * g
            square[n] = 0.99 * square[n] + 0.01 * g * g
            value += (speed[n] * (mean[n] / (1 - 0.9**epoch)) / (np.sqrt(square[n] / (1 - 0.99**epoch)) + 1e-7)).astype(value.dtype)
    return model


def sample_bounds(languages: int, per_language: int, most_chars: int) -> tuple[int, int]:
    """Rows of a language and characters of a row, within what MOST_COST leaves for a language (six characters a word)."""
    chars = 6 * MOST_COST // languages**3
    if per_language * most_chars <= chars:
        return per_language, most_chars
    rows = max(min(per_language, chars // 200), min(per_language, LEAST_ROWS))
    return rows, max(min(most_chars, chars // rows), 40)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", order_col: str = "doc_id", per_language: int = PER_LANGUAGE, most_chars: int = MOST_CHARS) -> Model | None:
    """The model from a bounded sample; None if no row has a label and a text with a letter."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"), F.xxhash64(F.col(order_col), F.lit(11)).alias("h"))
    rows = rows.where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = cut(rows.groupBy("label").agg(F.count("*").alias("n"), F.min("h").cast("double").alias("least")), "labels")
    labels = sizes.count()
    if not labels:
        return None
    per_language, most_chars = sample_bounds(labels, per_language, most_chars)
    # a share of the hash range that holds about twice the rows wanted, and one at least; then the first of them
    full = 2.0**64
    bound = F.greatest(F.least(2.0 * per_language / F.col("n"), F.lit(1.0)) * full - full / 2, "least")
    near = rows.join(sizes.select(F.col("label").alias("of"), bound.alias("bound")), F.col("label") == F.col("of")).where(F.col("h").cast("double") <= F.col("bound"))
    # of a long text one of its windows with a letter
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / most_chars).cast("int")), lambda i: F.substring(F.col("text"), i * most_chars + 1, F.lit(most_chars)))
    lettered = F.filter(windows, lambda w: w.rlike(r"\p{L}"))
    window = F.element_at(lettered, (F.pmod(F.col("h"), F.size(lettered)) + 1).cast("int"))
    near = near.select("label", "h", F.when(F.length("text") > most_chars, window).otherwise(F.col("text")).alias("text"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))
    sample = sorted(near.withColumn("place", place).where(F.col("place") <= per_language).collect(), key=lambda r: (r.label, r.place))
    texts, labels = [r.text for r in sample], [r.label for r in sample]
    model = train(texts, labels)
    learn_evidence(model, texts, labels)
    return model


def label(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, evidence: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_switches, with spans an array of (lang, first_word, n_words), with evidence a number (about 1 is usual)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    if model is None:
        model = Model([UNKNOWN], np.zeros((len(_ORDERS), _TABLE, 1), np.float32), np.zeros(0, np.uint64), np.zeros((0, 1), np.float32), np.zeros((1, 1)), np.zeros(1), np.zeros((1, 1)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType().add("lang", "string").add("first_word", "long").add("n_words", "long")
    schema = T.StructType().add("doc_id", rows.schema["doc_id"].dataType).add("lang_pred", "string").add("score", "double").add("n_words", "long").add("n_switches", "long")
    schema = schema.add("spans", T.ArrayType(span)) if spans else schema
    schema = schema.add("evidence", "double") if evidence else schema
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    def run(batches):
        own = shared.value
        names = np.array(own.languages, object)
        for batch in batches:
            texts, letters = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            wide = max(len(names), 4) // 4
            for begin, end in text_groups(texts, 1_500_000 // wide):
                buffer, starts, ends, place, begins = distinct_words(texts[begin:end])
                scores = block_emissions(own, buffer, starts, ends, np.float32)
                block = 50_000 // wide
                met = np.zeros((len(starts), len(names)), bool)
                if evidence and own.seen:
                    for i in range(0, len(starts), block):
                        a, b = starts[i : i + block], ends[i : i + block]
                        met[i : i + block] = recognised(own.seen, buffer[a[0] : b[-1]], a - a[0], b - a[0])
                scores = scores[place]
                found = marginals(scores, begins, own.moves.astype(np.float32))
                n = np.diff(begins)
                total = np.zeros((len(n), len(names)))
                if len(found):
                    some = np.flatnonzero(n)
                    total[some] = np.add.reduceat(found, begins[:-1][some], axis=0)
                mean = total / np.maximum(n, 1)[:, None]
                best = mean.argmax(axis=1)
                known = letters[begin:end] & (n > 0) & (own.languages != [UNKNOWN])
                word = found.argmax(axis=1) if len(found) else np.zeros(0, np.int64)
                change = np.zeros(len(word) + 1, np.int64)
                change[1:-1] = word[1:] != word[:-1]
                change[begins] = 0
                switches = np.concatenate(([0], np.cumsum(change)))
                columns = [batch.column(0).slice(begin, end - begin), pa.array(np.where(known, names[best], UNKNOWN), pa.string()), pa.array(np.where(known, np.clip(mean.max(axis=1), 0, 1), 0.0)), pa.array(n), pa.array(switches[begins[1:]] - switches[begins[:-1]])]
                if spans:
                    out = []
                    for a, b in zip(begins[:-1], begins[1:]):
                        cuts = [a, *(np.flatnonzero(change[a:b]) + a), b] if b > a else []
                        out.append([{"lang": names[word[x]], "first_word": x - a, "n_words": y - x} for x, y in zip(cuts, cuts[1:])])
                    columns.append(pa.array(out, span_type))
                if evidence:
                    tells = telling(buffer, starts, ends)[place]
                    of_word = met[place, np.repeat(best, n)] & tells
                    hits, told = (np.diff(np.concatenate(([0], np.cumsum(x)))[begins]) for x in (of_word, tells))
                    usual = np.array(own.usual or [0.0] * len(names))[best]
                    share = np.where(usual > 0, hits / np.maximum(told, 1) / np.where(usual > 0, usual, 1), 0.0)
                    columns.append(pa.array(np.where(known, np.where(told > 0, share, 1.0), 0.0)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "n_words", "n_switches", *["spans"] * spans, *["evidence"] * evidence])

    return rows.mapInArrow(run, schema)
