"""Media columns: Netpbm and BMP images to numpy arrays, resized by area through
integral images, written as NPY tiles with difference hashes.

`text_media` stores a text's UTF-8 bytes, filled up with spaces, as the samples of
a binary PPM, and reads that PPM back for all that it reports.

Defined results: a null text counts as empty and gives one row of pixels; equal
texts give equal values; a null or unreadable image, one of more than MOST_PIXELS or with
fewer samples than its header says, gives null tile and hash from `tiles`; samples above
the top value count as it; rows that repeat are each answered; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm._common import chunks

WIDTH = 64
UNIT = WIDTH * 3
#: Pixels that an image's header may name; an array of more would not fit a worker.
MOST_PIXELS = 1 << 28
_TOKEN = re.compile(rb"(?:\s*#[^\n]*\n|\s)*([^\s#]+)")
_BINARY = {b"P4": (1, 1), b"P5": (1, None), b"P6": (3, None)}


def encode_ppm(pixels: np.ndarray) -> bytes:
    """A (height, width, 3) array of bytes as a binary PPM."""
    height, width, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[:2], 2, []
    bitmap = kind in (b"P1", b"P4")
    while len(numbers) < (2 if bitmap else 3):
        token = _TOKEN.match(data, at)
        if token is None:
            raise ValueError("a header that ends early")
        numbers.append(int(token[1]))
        at = token.end()
    width, height, top = *numbers[:2], 1 if bitmap else numbers[2]
    if width <= 0 or height <= 0 or not 0 < top < 65536 or width * height > MOST_PIXELS:
        raise ValueError("no image size")
    channels = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * (-(-width // 8)), at + 1).reshape(height, -1)
        samples = 1 - np.unpackbits(rows, axis=1)[:, :width]
    elif kind in _BINARY:
        wide = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
        samples = np.frombuffer(data, wide, height * width * channels, at + 1)
    elif kind in (b"P1", b"P2", b"P3"):
        rest = re.sub(rb"#[^\n]*", b"", data[at:])
        values = [b"%c" % x for x in rest if x in b"01"] if kind == b"P1" else rest.split()
        samples = np.array([int(x) for x in values[: height * width * channels]])
        samples = 1 - samples if kind == b"P1" else samples
    else:
        raise ValueError("no Netpbm image")
    samples = np.minimum(samples, top).reshape(height, width, channels) if top != 255 or kind not in _BINARY else samples.reshape(height, width, channels)
    return samples if top == 255 and samples.dtype == np.uint8 else (samples.astype(np.uint32) * 255 // top).astype(np.uint8)


def _decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette or grey), 24 or 32 bits."""
    start, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (8, 24, 32) or width <= 0 or height == 0 or width * abs(height) > MOST_PIXELS:
        raise ValueError("no BMP of 8, 24 or 32 bits without compression")
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:: 1 if height < 0 else -1]
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        return palette[rows[:, :width]]
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """A Netpbm or BMP file as an array (height, width, channels) of bytes."""
    return _decode_bmp(data) if data[:2] == b"BM" else _decode_netpbm(data)


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels[:, :, 0] if pixels.shape[2] == 1 else (pixels[:, :, 0] * np.uint32(77) + pixels[:, :, 1] * np.uint32(150) + pixels[:, :, 2] * np.uint32(29)) >> np.uint32(8)


def area_resize(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target pixel, from an integral image; edges that
    fall inside a source pixel take their share of it."""
    h, w = plane.shape
    integral = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(np.cumsum(plane, 0, dtype=np.int64), 1, out=integral[1:, 1:])

    def at(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(n + 1) * (size / n)
        low = np.minimum(edge.astype(np.int64), size - 1)
        return low, edge - low

    (y, fy), (x, fx) = at(h, height), at(w, width)
    rows = integral[y] * (1 - fy)[:, None] + integral[y + 1] * fy[:, None]
    sums = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    return np.diff(np.diff(sums, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(plane: np.ndarray) -> str:
    """64 bits, row by row: is a pixel of the 8 x 9 picture darker than the one to its right."""
    small = np.round(area_resize(plane, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(plane: np.ndarray, size: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.round(area_resize(plane, size, size)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def tiles(images: DataFrame, id_column: str, image_column: str, size: int = 32) -> DataFrame:
    """id, height, width, tile (NPY bytes, size x size grey) and difference hash of each image."""
    chosen = images.select(F.col(id_column), F.col(image_column).alias("__image"))
    schema = T.StructType([chosen.schema[0], T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("tile", T.BinaryType()), T.StructField("dhash", T.StringType())])

    def one(data: bytes | None) -> tuple:
        try:
            pixels = decode(data) if data else None
        except (ValueError, OverflowError, struct.error, IndexError):
            pixels = None
        if pixels is None:
            return None, None, None, None
        plane = grey(pixels)
        return *plane.shape, npy_tile(plane, size), difference_hash(plane)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x.as_py()) for x in batch.column("__image")]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return chosen.mapInArrow(run, schema)


def store_text(text: bytes) -> bytes:
    """The bytes and spaces up to a positive multiple of UNIT, as the samples of a PPM."""
    payload = text + b" " * (-len(text) % UNIT if text else UNIT)
    return encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3))


def text_media(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_media: bool = False, size: int = 32) -> DataFrame:
    """Digests of each text's stored image and of what is read back from it; with
    keep_media also the image and its NPY tile."""
    chosen = documents.select(F.col(id_column), F.col(text_column).alias("__text"))
    fields = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("tile_sha256", T.StringType())]
    fields += [("media", T.BinaryType()), ("tile", T.BinaryType())] * keep_media
    schema = T.StructType([chosen.schema[0], *(T.StructField(*f) for f in fields)])
    arrow = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}

    def one(text: str) -> tuple:
        raw = text.encode()
        media = store_text(raw)
        pixels = decode(media)
        payload, plane = pixels.tobytes(), grey(pixels)
        tile = npy_tile(plane, size)
        row = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(plane), hashlib.sha256(tile).hexdigest())
        return row + (media, tile) * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "__text"):
            found = [one(x.as_py()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(column, arrow[f[1]]) for column, f in zip(zip(*found, strict=True), fields, strict=True))], names=schema.names)

    return chosen.mapInArrow(run, schema)
