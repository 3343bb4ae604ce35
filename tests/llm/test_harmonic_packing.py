import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evenkeel.llm import harmonic_packing as hp
from evenkeel.llm import queries

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@given(st.integers(1, 20_000))
def test_cuts_cover_and_fill_their_class(n):
    cuts = hp.cut_lengths(n)
    assert sum(length for length, _ in cuts) == n
    for length, k in cuts:
        assert 2048 / (k + 1) < length <= 2048 / k
        assert length == 2048 // k or length * k >= (1 - 1 / 64) * 2048


def check(rows, ids_of):
    """Every id in exactly one piece, sequences gapless, little padding."""
    seqs = {}
    docs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    full = 0
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        full += at if at & (at - 1) == 0 else 2048
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(docs[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    used = sum(len(x) for x in ids_of.values())
    return 1 - used / full


def test_whole_table_against_the_library(spark, sf_dir):
    tk = Tokenizer.from_file(JSON)
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    ids = {d.doc_id: tk.encode(d.text or "", add_special_tokens=False).ids + [1] for d in docs}
    assert check(queries.op4_harmonic_packing(spark, sf_dir).collect(), ids) < 0.02


def test_fast_ids_equal_the_librarys():
    fast, plain = hp.tokenizer(JSON, RANKS), hp.tokenizer(JSON, None)
    texts = ["", "<|endoftext|> and more", "naïve café — “quoted” 100€ \u0085 x", "日本語 текст 😀😀 a᠎b", "x" * 3000, " \n\t \x1c\x1d\x85 y'll we've", "".join(map(chr, range(1, 0x250)))]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}" for c in range(1, 0x250)]
    for text in texts:
        assert fast(text).tolist() == plain(text).tolist(), repr(text)


def test_odd_inputs(spark):
    rows = [(1, None, 5), (2, "", 6), (2, "", 6), (None, "a b", 7), (3, "word " * 9000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    out = hp.pack(df, JSON, RANKS).collect()
    whole = {}
    for r in out:
        whole.setdefault(r.doc_id, 0)
        whole[r.doc_id] += r.length
    assert whole[1] == 1 and whole[2] == 2 and whole[None] == 3
    assert hp.pack(df.limit(0), JSON, RANKS).count() == 0
    with pytest.raises(ValueError):
        hp.pack(df, JSON, capacity=1000)


def test_fast_ids_equal_the_librarys_on_ten_thousand_documents(spark, sf_dir):
    more = os.path.join(os.path.dirname(sf_dir), "sf0.1")
    fast, plain = hp.tokenizer(JSON, RANKS), hp.tokenizer(JSON, None)
    for r in queries.table(spark, more if os.path.isdir(more) else sf_dir, "documents").select("text").collect():
        assert fast(r.text or "").tolist() == plain(r.text or "").tolist()


@given(st.text(st.sampled_from(list("ab1!'s \n\t é日😀")), max_size=60))
def test_any_text_has_the_librarys_ids(text):
    assert _FAST(text).tolist() == _PLAIN(text).tolist()


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 300_000 + " y", "z" * 300_000])
def test_long_runs(spark, text):
    rows = hp.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), JSON, RANKS).withColumn("ids_crc32", F.crc32("ids")).collect()
    assert check(rows, {1: _PLAIN(text).tolist() + [1]}) < 0.02


_FAST, _PLAIN = hp.tokenizer(JSON, RANKS), hp.tokenizer(JSON, None)
