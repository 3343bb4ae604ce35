import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from evenkeel.llm import common as c


def spans(text):
    buffer = np.frombuffer(text, np.uint8)
    return (buffer, *c.word_spans(buffer))


@given(st.binary(max_size=200))
def test_words_are_those_of_ascii_white_space(raw):
    buffer, starts, ends = spans(raw)
    assert [raw[a:b] for a, b in zip(starts, ends)] == raw.split()


@given(st.lists(st.sampled_from([b"a", b"ab", b"ba", b"\x00", b"\x00\x00", b"long" * 9]), max_size=60), st.integers(1, 40))
def test_hashes_know_words_by_their_bytes_alone(words, most):
    raw = b"  ".join(words)
    buffer, starts, ends = spans(raw)
    whole, blocks = c.span_hashes(buffer, starts, ends), c.span_hashes(buffer, starts, ends, most)
    assert (whole == blocks).all()
    assert len({*zip(words, whole.tolist())}) == len(set(words)) == len(set(whole.tolist()))


@pytest.mark.parametrize("texts", [["a b a", None, "", "B  c"], ["x " * 400_000, "y x"]])
def test_distinct_words(texts):
    buffer, starts, ends, place, begins = c.distinct_words(texts)
    raw = buffer.tobytes()
    words = [raw[a:b] for a, b in zip(starts, ends)]
    assert len(set(words)) == len(words)
    for text, a, b in zip(texts, begins, begins[1:]):
        assert [words[i] for i in place[a:b]] == c.lowered(text).split()


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 90)]
    up = {n: n for e in edges for n in e}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r.node: r.component for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root(n) for n in linked}
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_release(spark):
    import os

    df = c.cut(spark.range(3), "x")
    path = c._WRITTEN[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    c.release(spark)
    assert not os.path.exists(path) and not c._WRITTEN
