"""Netpbm and BMP images as columns: decoded to numpy arrays, area-resized, hashed, written as NPY tiles.

Formats: Netpbm P1 to P6 with 8- and 16-bit samples and comments in the header, and uncompressed BMP of 8 (grey or
palette), 24 and 32 bits, stored from the bottom or the top. Decoded arrays have the shape (height, width, channels);
Netpbm samples are scaled from the image's maximum to the full range of 8 or 16 bits.

Area resizing: an output sample is the mean of the input area that it covers, fractions of border samples included,
read from an integral image in whole numbers. The difference hash compares neighbours in each row of an 8 x 9 grey
tile: bit 1 where the right one is brighter; 64 bits as 16 hex digits.

Results that are defined: null or undecodable media give null in every derived column (`error` says why); an image with
no samples, with a sample above its maximum or outside its palette, or with a raster that ends early is undecodable; other columns of the input are kept by none of these functions, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HEADER = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def _numbers(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    found = []
    for _ in range(n):
        m = _HEADER.match(data, at)
        if not m or len(m[1]) > 9:
            raise ValueError("bad Netpbm header")
        found.append(int(m[1]))
        at = m.end()
    return found, at


def _need(data: bytes, n: int) -> None:
    if len(data) < n:
        raise ValueError("the raster is too short")


def _plain_samples(raster: bytes, n: int) -> np.ndarray:
    found = re.sub(rb"#[^\n]*", b"", raster).split()[:n]
    _need(found, n)
    if max(map(len, found)) > 9 or not b"".join(found).isdigit():
        raise ValueError("a sample is no number of nine digits at most")
    return np.array(found).astype(np.int64)


def decode_netpbm(data: bytes) -> np.ndarray:
    """Samples scaled from the image's own maximum to 255, or to 65535 if the maximum is above 255."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456" or not kind:
        raise ValueError("not Netpbm")
    channels = 3 if kind in b"36" else 1
    (width, height, *rest), at = _numbers(data, 2, 2 if kind in b"14" else 3)
    most = rest[0] if rest else 1
    if not 0 < most < 65536 or not width * height:
        raise ValueError("bad Netpbm size")
    if kind in b"456" and not data[at : at + 1].isspace():
        raise ValueError("bad Netpbm header")
    n = width * height * channels
    _need(data, at + (n if kind != b"4" else (width + 7) // 8 * height))
    if kind == b"1":
        bits = re.sub(rb"#[^\n]*|\s", b"", data[at:])[:n]
        _need(bits, n)
        flat = np.frombuffer(bits, np.uint8) - ord("0")
    elif kind in b"23":
        flat = _plain_samples(data[at:], n)
    elif kind == b"4":
        row = (width + 7) // 8
        flat = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row), axis=1)[:, :width]
    else:
        flat = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1)
    if flat.max() > most:
        raise ValueError("a sample is above the maximum")
    full = 65535 if most > 255 else 255
    if kind in b"14":
        flat = 1 - flat
    if most != full:
        flat = (flat.astype(np.int64) * full + most // 2) // most
    return flat.astype(np.uint16 if most > 255 else np.uint8, copy=False).reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    offset, head, width, height, _, bits, packed = struct.unpack_from("<I I i i H H I", data, 10)
    if packed or head < 40 or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("BMP of a kind that isn't read")
    row = (width * bits // 8 + 3) // 4 * 4
    _need(data, offset + row * abs(height))
    raw = np.frombuffer(data, np.uint8, row * abs(height), offset).reshape(abs(height), row)[:, : width * bits // 8]
    if height > 0:
        raw = raw[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        if used > 256 or raw.max() >= used:
            raise ValueError("a sample is outside the palette")
        _need(data, 14 + head + 4 * used)
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(used, 4)[:, 2::-1]
        if (palette[:, :1] == palette).all() and (palette[:, 0] == np.arange(used)).all():
            return raw[:, :, None]
        return palette[raw]
    return raw.reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels); ValueError or struct.error if it can't be decoded."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit grey (height, width) as P5."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit RGB (height, width, 3) as a 24-bit BMP, stored from the bottom."""
    height, width = pixels.shape[:2]
    row = (width * 3 + 3) // 4 * 4
    raster = np.zeros((height, row), np.uint8)
    raster[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, width * 3)
    size = row * height
    return b"BM" + struct.pack("<IHHI IiiHHIIiiII", 54 + size, 0, 0, 54, 40, width, height, 1, 24, 0, size, 2835, 2835, 0, 0) + raster.tobytes()


def area_sums(pixels: np.ndarray, sizes: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each (height, width) the sums over the areas of its samples, times height * width: whole numbers, so exact.

    Only those rows and columns of the integral image are kept between which an area ends; strips of rows bound the memory.
    """
    h, w, c = pixels.shape
    edges = [(np.arange(height + 1) * h, np.arange(width + 1) * w) for height, width in sizes]

    def between(table: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Values of the first axis of a cumulated table at `at / n`, times n."""
        low = np.minimum(at // n, len(table) - 2)
        share = (at - low * n).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (n - share) + table[low + 1] * share

    tops = [np.zeros((1, width + 1, c), np.int64) for _, width in sizes]
    kept: list[list[np.ndarray]] = [[] for _ in sizes]
    step = max(1, (1 << 18) // (w * c))
    for begin in range(0, h, step):
        part = pixels[begin : begin + step]
        across = np.zeros((w + 1, len(part), c), np.int64)
        np.cumsum(part.transpose(1, 0, 2), axis=0, dtype=np.int64, out=across[1:])
        for i, ((height, width), (rows, columns)) in enumerate(zip(sizes, edges)):
            down = np.concatenate([tops[i], tops[i] + np.cumsum(between(across, columns, width).transpose(1, 0, 2), axis=0)])
            tops[i] = down[-1:]
            own = rows[(rows >= begin * height) & ((rows < (begin + len(part)) * height) | (begin + len(part) == h))] - begin * height
            if len(own):
                kept[i].append(between(down, own, height))
    return [np.diff(np.diff(np.concatenate(k), axis=0), axis=1) for k in kept]


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """(height, width, channels) means over areas."""
    return area_sums(pixels, [(height, width)])[0] / (pixels.shape[0] * pixels.shape[1])


def _hash_of(sums: np.ndarray) -> str:
    grey = sums.sum(axis=2)
    return np.packbits(grey[:, 1:] > grey[:, :-1]).tobytes().hex()


def difference_hash(pixels: np.ndarray) -> str:
    return _hash_of(area_sums(pixels, [(8, 9)])[0])


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def image_columns(media: DataFrame, id_col: str, media_col: str, tile: int = 32) -> DataFrame:
    """id, height, width, channels, samples (decoded bytes, row by row), npy (tile x tile x channels, uint8), dhash, error."""
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType)] + [T.StructField(n, T.IntegerType()) for n in ("height", "width", "channels")] + [T.StructField(n, T.BinaryType()) for n in ("samples", "npy")] + [T.StructField(n, T.StringType()) for n in ("dhash", "error")])

    def one(data):
        if data is None:
            return None, None, None, None, None, None, None
        try:
            pixels = decode(data)
        except (ValueError, struct.error) as e:
            return None, None, None, None, None, None, str(e)[:200]
        sums, coarse = area_sums(pixels, [(tile, tile), (8, 9)])
        scale = pixels.shape[0] * pixels.shape[1] * (257 if pixels.dtype.itemsize == 2 else 1)
        small = np.floor(sums / scale + 0.5).astype(np.uint8)
        return *pixels.shape, pixels.tobytes(), npy(small), _hash_of(coarse), None

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                found = [one(x.as_py()) for x in part.column(1)]
                kinds = [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, most: int = 8 << 20):
    """Parts of about `most` bytes; a longer row stands alone."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)]
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def payload(raw: bytes, unit: int = 576) -> bytes:
    """raw with bytes 255 up to a positive multiple of unit."""
    return raw + b"\xff" * ((-len(raw)) % unit or (0 if raw else unit))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 576) -> DataFrame:
    """Each text as an image: id, n_bytes, payload_bytes, format, media.

    Rows of `unit` bytes. An odd number of rows becomes a grey PGM, an even one a 24-bit BMP of unit / 3 pixels a row.
    A null text is an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("format", T.StringType()), T.StructField("media", T.BinaryType())])

    def one(raw: bytes):
        full = np.frombuffer(payload(raw, unit), np.uint8).reshape(-1, unit)
        if len(full) % 2:
            return len(raw), full.size, "pgm", encode_pgm(full)
        return len(raw), full.size, "bmp", encode_bmp(full.reshape(len(full), unit // 3, 3))

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                found = [one(x.as_py()) for x in part.column(1)]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)


def text_image_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 576) -> DataFrame:
    """The round trip of every text: what was stored, what was read back, and its features."""
    stored = text_media(docs, id_col, text_col, unit)
    media = stored.select(F.struct(F.col("id"), "n_bytes", "payload_bytes", "format", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("about"), "media")
    seen = image_columns(media, "about", "media")
    return seen.select("id.*", "samples", "npy", "dhash").select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        "payload_bytes",
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -32, 32)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.col("dhash").alias("feature"),
        "format",
        F.sha2("npy", 256).alias("npy_sha256"),
    )
