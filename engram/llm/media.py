"""Media columns: Netpbm and BMP rasters as numpy arrays, tiles and difference hashes.

``decode`` reads Netpbm (P1-P6) and uncompressed BMP (8-bit palette, 24- and
32-bit) into uint8 arrays, ``area_resize`` averages exact areas through an
integral image, ``npy_tile`` writes an array in NPY format and
``difference_hash`` compares neighbouring samples of the resized image.
``text_media`` stores documents losslessly as PGM rasters and reads them back.

Defined results
---------------
* A null text is the empty text.  The payload is the text's UTF-8 bytes followed
  by 255s up to a positive multiple of 576, so an empty text is one block of 255s.
* Equal texts give equal values in every row; repeated rows get theirs each.
* Very long texts are summed in place (one integral row a boundary), never copied
  to a wider type as a whole.
* Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import give_back, table

BLOCK = 576
WIDTH = 24
HASH_ROWS, HASH_COLUMNS = 8, 9
_HEADER = re.compile(rb"(P[1-6])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 2)
_MAXVAL = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)")


def encode_pgm(image: np.ndarray) -> bytes:
    """A grey uint8 image as binary PGM."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """A grey uint8 image as 8-bit BMP, or an RGB one as 24-bit BMP."""
    height, width = image.shape[:2]
    deep = image.ndim == 3
    palette = b"" if deep else np.repeat(np.arange(256, dtype="u1")[:, None], 4, 1).tobytes()
    line = width * (3 if deep else 1)
    rows = np.zeros((height, (line + 3) // 4 * 4), "u1")
    rows[:, :line] = (image[::-1, :, ::-1] if deep else image[::-1]).reshape(height, line)
    start = 54 + len(palette)
    head = b"BM" + np.array([start + rows.size, 0, start, 40, width, height], "<u4").tobytes()
    head += np.array([1, 24 if deep else 8], "<u2").tobytes() + np.array([0, rows.size, 2835, 2835, 0 if deep else 256, 0], "<u4").tobytes()
    return head + palette + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    head = _HEADER.match(data)
    if not head:
        raise ValueError("not a Netpbm header")
    kind, width, height, at, most = head[1], int(head[2]), int(head[3]), head.end(), 1
    if kind not in (b"P1", b"P4"):
        top = _MAXVAL.match(data, at)
        if not top:
            raise ValueError("no maximum value")
        most, at = int(top[1]), top.end()
    depth = 3 if kind in (b"P3", b"P6") else 1
    shape = (height, width, 3) if depth == 3 else (height, width)
    n = width * height * depth
    if kind == b"P1":
        digits = re.sub(rb"#[^\n]*|\s", b"", data[at:])[:n]
        out = 1 - (np.frombuffer(digits, "u1") - 48)
    elif kind in (b"P2", b"P3"):
        out = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], "u2")
    elif kind == b"P4":
        line = (width + 7) // 8
        bits = np.frombuffer(data, "u1", line * height, at + 1).reshape(height, line)
        out = 1 - np.unpackbits(bits, axis=1)[:, :width].ravel()
    else:
        out = np.frombuffer(data, "u1" if most < 256 else ">u2", n, at + 1)
    if len(out) != n:
        raise ValueError("raster ends early")
    out = out.reshape(shape)
    return out if most == 255 and out.dtype == np.uint8 else (out.astype("u8") * 255 // most).astype("u1")


def _bmp(data: bytes) -> np.ndarray:
    start, width = int.from_bytes(data[10:14], "little"), int.from_bytes(data[18:22], "little", signed=True)
    height, bits = int.from_bytes(data[22:26], "little", signed=True), int.from_bytes(data[28:30], "little")
    if int.from_bytes(data[30:34], "little") or bits not in (8, 24, 32) or width <= 0:
        raise ValueError("only uncompressed 8-, 24- and 32-bit BMP")
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, "u1", line * abs(height), start).reshape(abs(height), line)[:, : width * bits // 8]
    rows = rows if height < 0 else rows[::-1]
    if bits != 8:
        return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    size = 14 + int.from_bytes(data[14:18], "little")
    palette = np.frombuffer(data, "u1", (start - size) // 4 * 4, size).reshape(-1, 4)[:, 2::-1]
    seen = palette[rows]
    return seen[:, :, 0] if (palette[:, :1] == palette).all() else seen


def decode(data: bytes) -> np.ndarray:
    """A Netpbm or BMP file as a uint8 array, (rows, columns) or (rows, columns, 3)."""
    return _bmp(data) if data[:2] == b"BM" else _netpbm(data)


def _edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * n / parts
    low = np.minimum(np.floor(at).astype(int), n - 1)
    return low, at - low


def _integral_rows(image: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of the integral image: sums of all samples above each row, cumulated along columns."""
    cuts = np.unique(np.concatenate(([0], rows[rows < len(image)])))
    sums = np.add.reduceat(image, cuts, axis=0, dtype=np.int64)
    table_ = np.zeros((len(cuts) + 1, image.shape[1] + 1), np.float64)
    table_[1:, 1:] = sums.cumsum(0).cumsum(1)
    return table_[np.searchsorted(np.append(cuts, len(image)), rows)]


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area averages of a grey image, taken from its integral image."""
    low, part = _edges(image.shape[0], height)
    lines = _integral_rows(image, np.concatenate((low, low + 1)))
    a, b = lines[: height + 1], lines[height + 1 :]
    rows = a + (b - a) * part[:, None]
    low, part = _edges(image.shape[1], width)
    corners = rows[:, low] + (rows[:, low + 1] - rows[:, low]) * part
    area = image.shape[0] * image.shape[1] / (height * width)
    return np.diff(np.diff(corners, axis=0), axis=1) / area


def difference_hash(small: np.ndarray) -> int:
    """One bit for each pair of neighbours in a row: does the left one exceed the right one?"""
    return int.from_bytes(np.packbits(small[:, :-1] > small[:, 1:]).tobytes(), "big")


def npy_tile(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image @ np.array([299, 587, 114]) // 1000).astype("u1")


def payload_of(text: bytes, block: int = BLOCK) -> bytes:
    return text + b"\xff" * (max(block, -(-len(text) // block) * block) - len(text))


def media_tiles(files: DataFrame, height: int = HASH_ROWS, width: int = HASH_COLUMNS) -> DataFrame:
    """(id, rows, columns, tile, hash) of media files (id, media): the resized NPY tile and its difference hash.

    Null and undecodable media give null columns.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ident, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    image = decode(media)
                    small = area_resize(grey(image), height, width)
                    tile = npy_tile(np.rint(small).astype("u1"))
                    out.append((ident, image.shape[0], image.shape[1], tile, f"{difference_hash(small):016x}"))
                except (ValueError, TypeError, IndexError):
                    out.append((ident, None, None, None, None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (batch.column(0).type, pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "rows", "columns", "tile", "hash"]
            )

    kind = files.schema["id"].dataType.simpleString()
    return files.select("id", F.col("media").cast("binary")).mapInArrow(
        read, f"id {kind}, rows int, columns int, tile binary, hash string"
    )


DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


#: Bytes of media that a batch holds at most (one file may be larger).
BATCH_BYTES = 8 << 20


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], weight: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded bytes; column ``weight`` holds the bytes that count."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight])
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text of ``docs`` (doc_id, text) as a PGM file."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = text.as_py() or b""
                    yield doc_id, len(raw), encode_pgm(np.frombuffer(payload_of(raw), "u1").reshape(-1, WIDTH))

        yield from _batches(files(), [pa.int64(), pa.int64(), pa.binary()], ["doc_id", "n_bytes", "media"], 2)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def text_media(docs: DataFrame, with_files: bool = True) -> DataFrame:
    """Store each text of ``docs`` (doc_id, text) as a PGM file in a column, read the column back and compute its features.

    With ``with_files`` the PGM file and the NPY tile come as binary columns ``media`` and
    ``tile``; without it only what is derived from the stored files.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in DIGESTS.split(", ")] + ["media", "tile"]
        n = len(names) if with_files else len(names) - 2

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, n_bytes, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    media = stored.as_py()
                    image = decode(media)
                    back = image.tobytes()
                    tile = npy_tile(np.rint(small := area_resize(image, HASH_ROWS, HASH_COLUMNS)).astype("u1"))
                    row = (
                        doc_id, n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media),
                        hashlib.sha256(media).hexdigest(), f"{difference_hash(small):016x}-{zlib.crc32(tile):08x}", media, tile,
                    )
                    yield row[:n]

        yield from _batches(rows(), types[:n], names[:n], n - 2 if with_files else 3)
        give_back()

    schema = DIGESTS + (", media binary, tile binary" if with_files else "")
    return store_texts(docs).mapInArrow(read, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"), with_files=False)
