import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from evenkeel.llm import media_columns as mc
from evenkeel.llm import queries

RNG = np.random.default_rng(3)


def test_netpbm_kinds():
    grey = RNG.integers(0, 256, (3, 5)).astype(np.uint8)
    colour = RNG.integers(0, 256, (2, 3, 3)).astype(np.uint8)
    text = lambda a: b" ".join(b"%d" % x for x in a.reshape(-1))
    assert (mc.decode(mc.encode_pgm(grey))[:, :, 0] == grey).all()
    assert (mc.decode(b"P2\n# note\n5 3\n255\n" + text(grey))[:, :, 0] == grey).all()
    assert (mc.decode(b"P3 3 2 255\n" + text(colour)) == colour).all()
    assert (mc.decode(b"P6 3 2 255\n" + colour.tobytes()) == colour).all()
    bits = RNG.integers(0, 2, (3, 11)).astype(np.uint8)
    assert (mc.decode(b"P4 11 3\n" + np.packbits(bits, axis=1).tobytes())[:, :, 0] == (1 - bits) * 255).all()
    assert (mc.decode(b"P1 11 3\n" + b"".join(b"%d" % x for x in bits.reshape(-1)))[:, :, 0] == (1 - bits) * 255).all()
    wide = RNG.integers(0, 65536, (2, 2)).astype(">u2")
    assert (mc.decode(b"P5 2 2 65535\n" + wide.tobytes())[:, :, 0] == wide).all()


def test_bmp_round_trip():
    for width in (1, 2, 3, 4, 192):
        pixels = RNG.integers(0, 256, (7, width, 3)).astype(np.uint8)
        assert (mc.decode(mc.encode_bmp(pixels)) == pixels).all()


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (64, 9), (33, 100)])
def test_area_resize_against_brute_force(shape):
    pixels = RNG.integers(0, 256, (*shape, 2)).astype(np.uint8)
    big = np.kron(pixels, np.ones((8, 9, 1)))  # each sample as 8 x 9 equal ones: every area is whole
    want = big.reshape(8, shape[0], 9, shape[1], 2).mean(axis=(1, 3))
    assert np.allclose(mc.area_resize(pixels, 8, 9), want)


def test_bad_media_and_nulls(spark):
    rows = [(1, None), (2, bytearray(b"")), (3, bytearray(b"P5 2 2 255\n12")), (4, bytearray(b"junk")), (5, bytearray(mc.encode_pgm(np.zeros((1, 1)))))]
    out = {r.id: r for r in mc.image_columns(spark.createDataFrame(rows, "npy long, media binary"), "npy", "media").collect()}
    assert all(out[i].dhash is None for i in (1, 2, 3, 4)) and out[1].error is None and out[3].error
    assert out[5].dhash == "0" * 16 and bytes(out[5].npy).startswith(b"\x93NUMPY")


def test_whole_table(spark, sf_dir):
    out = {r.doc_id: r for r in queries.op8_media_columns(spark, sf_dir).collect()}
    docs = queries.table(spark, sf_dir, "documents").collect()
    assert len(out) == len(docs)
    for d in docs:
        full = mc.payload((d.text or "").encode())
        r = out[d.doc_id]
        assert r.n_bytes == len((d.text or "").encode()) and r.payload_bytes == len(full) and len(full) % 576 == 0 and full
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.tail_crc32 == zlib.crc32(full[-32:])


def test_null_and_empty_text(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y")], "doc_id long, text string, media string")
    out = mc.text_image_digests(df).collect()
    assert len(out) == 3 and {r.n_bytes for r in out} == {0} and {r.payload_bytes for r in out} == {576} and len({r.media_sha256 for r in out}) == 1
    assert mc.text_image_digests(df.limit(0)).count() == 0


def overlaps(n, parts):
    """parts x n: how much of sample j lies in part i, in parts of 1 / parts of a sample."""
    i, j = np.arange(parts)[:, None], np.arange(n)[None, :]
    return np.maximum(np.minimum((i + 1) * n, (j + 1) * parts) - np.maximum(i * n, j * parts), 0)


def test_features_and_tiles_of_the_whole_table(spark, sf_dir):
    out = {r.doc_id: r for r in queries.op8_media_columns(spark, sf_dir).collect()}
    for d in queries.table(spark, sf_dir, "documents").collect():
        full = np.frombuffer(mc.payload((d.text or "").encode()), np.uint8).reshape(-1, 576).astype(np.int64)
        pixels = full[:, :, None] if len(full) % 2 else full.reshape(len(full), 192, 3)
        h, w, _ = pixels.shape
        coarse = np.einsum("ih,hwc,jw->ij", overlaps(h, 8), pixels, overlaps(w, 9))
        assert out[d.doc_id].feature == np.packbits(coarse[:, 1:] > coarse[:, :-1]).tobytes().hex()
        tile = np.einsum("ih,hwc,jw->ijc", overlaps(h, 32), pixels, overlaps(w, 32), optimize=True)
        assert out[d.doc_id].npy_sha256 == hashlib.sha256(mc.npy(np.ascontiguousarray(np.floor(tile / (h * w) + 0.5).astype(np.uint8)))).hexdigest()


def test_strips_give_the_same_sums(monkeypatch):
    pixels = RNG.integers(0, 256, (301, 2000, 1)).astype(np.uint8)
    h, w, _ = pixels.shape
    for size in [(8, 9), (32, 32), (400, 3)]:
        want = overlaps(h, size[0]) @ pixels[:, :, 0].astype(np.int64) @ overlaps(w, size[1]).T
        assert (mc.area_sums(pixels, [size])[0][:, :, 0] == want).all()


def test_samples_are_scaled_by_the_maximum():
    assert mc.decode(b"P5 1 1 15 \x0f").item() == 255 and mc.decode(b"P5 2 1 15 \x00\x07").ravel().tolist() == [0, 119]
    assert mc.decode(b"P5 1 1 1023 \x03\xff").item() == 65535
    assert mc.decode(b"P2 2 1 100\n0100 0").ravel().tolist() == [255, 0]
    for bad in [b"P2 1 1 255\n300", b"P5 1 1 15 \x10", b"P2 1 1 255\n-1", b"P2 1 1 255\n1_0", b"P1 1 1\n7", b"P5 1 1 255"]:
        with pytest.raises(ValueError):
            mc.decode(bad)


@given(st.sampled_from([b"P1", b"P2", b"P3", b"P4", b"P5", b"P6", b"BM", b""]), st.binary(max_size=90))
def test_any_bytes_decode_or_raise_value_error(head, rest):
    try:
        assert mc.decode(head + rest).size
    except (ValueError, struct.error):
        pass


@given(st.integers(0, 63), st.binary(max_size=8), st.sampled_from([8, 24, 32]))
def test_damaged_bmps_decode_or_raise_value_error(at, damage, bits):
    body = b"BM" + struct.pack("<IHHI IiiHHIIiiII", 90, 0, 0, 62, 40, 2, 2, 1, bits, 0, 16, 0, 0, 2, 2) + b"\x00\x00\x00\x00\xff\xff\xff\x00" + b"\x00\x01\x00\x00" * 8
    try:
        assert mc.decode(body[:at] + damage + body[at + len(damage) :]).size
    except (ValueError, struct.error):
        pass


def test_huge_sizes_and_bad_palettes_are_null_columns(spark):
    palette = b"BM" + struct.pack("<IHHI IiiHHIIiiII", 62, 0, 0, 58, 40, 1, 1, 1, 8, 0, 4, 0, 0, 1, 1) + b"\x00" * 4 + b"\x05\x00\x00\x00"
    rows = [(1, bytearray(palette)), (2, bytearray(b"P5 " + b"9" * 30 + b" 1 255 1")), (3, bytearray(b"P2 1 1 255 " + b"9" * 40)), (4, bytearray(b"P5 999999999 999999999 255 1"))]
    out = mc.image_columns(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()
    assert all(r.dhash is None and r.error for r in out)


def test_a_very_long_text(spark):
    text = "word and more " * 400_000
    r = mc.text_image_digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.payload_sha256 == hashlib.sha256(mc.payload(text.encode())).hexdigest() and r.n_bytes == len(text)
