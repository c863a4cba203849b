"""Texts as progressive JPEG columns: stored without loss, read back, turned into tensors.

A payload is the text's UTF-8 bytes with zeros up to a positive multiple of 64. Its bytes are
the quantised coefficients of a 4:2:0 image, 64 to a block in zigzag order, less an offset, so
storing is lossless: entropy coding keeps coefficients as they are. Blocks fill MCUs in order;
a comment holds the text's number of bytes. Reading accumulates the spectral bands and the
successive bits into coefficient arrays, gives the payload back, and goes on to the picture:
inverse transform, chroma brought to full resolution, an RGB tensor of 8-bit values.

All sums are integers, so equal texts give equal files, tensors and features anywhere.

Defined results: a null text is an empty one, whose payload is 64 zeros; repeated rows stay;
other columns are not read; no rows give no rows. A text may have up to 6 GB.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hexaloc.llm._progressive import decode, encode, rgb, samples

#: The byte that becomes 0. Rare in texts, as small coefficients are costly to refine.
OFFSET = 93
#: Payload bytes that are coded together; a longer text makes a batch of its own.
BATCH = 1 << 21


def image_of(text: bytes) -> tuple[int, int, np.ndarray, bytes]:
    """MCUs across and down, coefficients and comment of a text's image."""
    size = max(64, -(-len(text) // 64) * 64)
    n = -(-size // 384)
    mw = math.isqrt(n - 1) + 1
    mh = -(-n // mw)
    blocks = np.zeros((mw * mh * 6, 64), np.int32)
    payload = np.zeros(size, np.uint8)
    payload[: len(text)] = np.frombuffer(text, np.uint8)
    blocks[: size // 64] = payload.reshape(-1, 64)
    blocks[: size // 64] -= OFFSET
    return mw, mh, blocks, struct.pack(">Q", len(text))


def payload_of(blocks: np.ndarray, comment: bytes) -> tuple[int, bytes]:
    """The text's number of bytes and the payload that an image's coefficients hold."""
    n = struct.unpack(">Q", comment)[0]
    return n, (blocks[: max(1, -(-n // 64))] + OFFSET).astype(np.uint8).tobytes()


def grid_means(tensor: np.ndarray, side: int = 4) -> str:
    """Mean R, G and B of a grid of equal parts, as hex."""
    rows, cols = (np.arange(side) * n // side for n in tensor.shape[:2])
    sums = np.add.reduceat(np.add.reduceat(tensor, rows, axis=0, dtype=np.int64), cols, axis=1)
    area = np.outer(np.diff(rows, append=tensor.shape[0]), np.diff(cols, append=tensor.shape[1]))
    return (sums // area[:, :, None]).astype(np.uint8).tobytes().hex()


def _batches(sizes: list[int]) -> Iterator[slice]:
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > BATCH:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if sizes:
        yield slice(at, len(sizes))


def stored(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, media: the progressive JPEG file of each whole text."""
    docs = docs.select(key, text)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_string()).fill_null("").cast(pa.large_binary())
            sizes = [len(t.as_buffer()) for t in texts]
            for part in _batches(sizes):
                files = encode([image_of(t.as_py()) for t in texts.slice(part.start, part.stop - part.start)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part.start, part.stop - part.start), pa.array(files, pa.binary())], ["key", "media"])

    return docs.mapInArrow(run, f"key {kind}, media binary")


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int"


def read_back(media: DataFrame, tensors: bool = True) -> DataFrame:
    """key, what the stored bytes give, and with tensors the RGB tensor (rows of pixels of 3 bytes)."""
    kind = media.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(x.as_buffer()) for x in b.column(1)]
            for part in _batches(sizes):
                files = b.column(1).slice(part.start, part.stop - part.start).to_pylist()
                rows = []
                pictures = []
                for data, (mw, mh, blocks, comment) in zip(files, decode(files)):
                    n, payload = payload_of(blocks, comment)
                    tensor = rgb(mw, mh, samples(blocks))
                    rows.append((n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), sha256(data).hexdigest(), grid_means(tensor), mh * 16, mw * 16))
                    pictures.append(tensor.tobytes() if tensors else None)
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()])]
                names = ["key", *(x.split()[0] for x in FEATURES.split(", "))]
                if tensors:
                    cols.append(pa.array(pictures, pa.binary()))
                    names.append("rgb")
                yield pa.RecordBatch.from_arrays([b.column(0).slice(part.start, part.stop - part.start), *cols], names)

    return media.select("key", "media").mapInArrow(run, f"key {kind}, {FEATURES}" + (", rgb binary" if tensors else ""))
