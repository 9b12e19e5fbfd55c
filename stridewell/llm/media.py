"""Media columns: texts kept as lossless WebP images and read back."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewell.llm import webp
from stridewell.llm.common import text_slices

ROW = 64
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
    " media_bytes long, media_sha256 string, feature string, tools string"
)
#: Bytes and number of texts whose images are made and decoded together.
BLOCK, ROWS = 6 << 20, 4096


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of bytes followed by zeros up to a positive multiple of 64."""
    size = np.diff(offsets)
    full = np.maximum(ROW, -(-size // ROW) * ROW)
    start = np.concatenate([[0], np.cumsum(full)])
    out = np.zeros(int(start[-1]), np.uint8)
    out[np.arange(len(data)) + np.repeat(start[:-1] - offsets[:-1], size)] = data
    return out, start


def feature(pixels: bytes) -> str:
    """Integers of the decoded samples: sum, sum of steps between neighbours
    in a row, and how many fall in each quarter of the range."""
    x = np.frombuffer(pixels, np.uint8)
    grid = x.reshape(-1, ROW).astype(np.int16)
    steps = int(np.abs(np.diff(grid, axis=1)).sum(dtype=np.int64))
    quarters = np.bincount(x >> 6, minlength=4)
    return f"{int(x.sum(dtype=np.int64))}:{steps}:" + ",".join(map(str, quarters))


def store(column: pa.Array):
    """(unpadded size, payload size, stored image, tools) of each text, by
    blocks."""
    for row in range(0, len(column), ROWS):
        for _, _, data, offsets in text_slices(column.slice(row, ROWS), BLOCK):
            payload, start = padded(data, offsets)
            images, tools = webp.encode_bytes(payload, start)
            yield np.diff(offsets), np.diff(start), images, tools


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: sizes and digests of the payload that was read
    back and of the stored image, a feature of its pixels, and the tools of the
    encoder that made the smallest image.  Null counts as
    empty text, whose payload is 64 zero bytes; null ids and repeated rows
    stay; an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for sizes, full, images, tools in store(batch.column("text")):
                for n, m, image, used, pixels in zip(sizes, full, images, tools, webp.decode_bytes(images)):
                    payload = pixels[:m]
                    row = (
                        int(n),
                        int(m),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-ROW:]),
                        len(image),
                        hashlib.sha256(image).hexdigest(),
                        feature(payload),
                        used,
                    )
                    for c, x in zip(columns, row):
                        c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, SCHEMA)


def to_images(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored images themselves: doc_id, n_bytes, media binary."""

    def run(batches):
        for batch in batches:
            sizes, images = [], []
            for own, _, stored, _ in store(batch.column("text")):
                sizes += own.tolist()
                images += stored
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pixel_arrays(media: DataFrame) -> DataFrame:
    """Decode a ``media`` column of any lossless WebP images: adds height,
    width, pixels (red, green, blue, alpha of each, row order) and error;
    columns of these four names are replaced.  Null
    or broken images have null pixels and say why."""

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column("media").to_pylist():
                try:
                    image = webp.decode(x or b"")
                    rows.append((*image.shape[:2], image.tobytes(), None))
                except webp.BadImage as why:
                    rows.append((None, None, None, str(why)))
            height, width, pixels, error = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(height, pa.int32()),
                    pa.array(width, pa.int32()),
                    pa.array(pixels, pa.binary()),
                    pa.array(error, pa.string()),
                ],
                [*batch.schema.names, "height", "width", "pixels", "error"],
            )

    plain = media.drop("height", "width", "pixels", "error")
    fields = ", ".join(f"`{n}` {t}" for n, t in plain.dtypes)
    return plain.mapInArrow(run, f"{fields}, height int, width int, pixels binary, error string")
