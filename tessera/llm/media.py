"""Media columns: texts stored as progressive JPEG, read back as full-resolution RGB tensors.

A text's UTF-8 bytes, with zero bytes up to a positive multiple of 64, are the coefficients of a progressive JPEG (see
``jpeg``). Reading a media column decodes all scans, returns the payload and computes features of the RGB tensor; the
tensor itself comes with ``tensors``. Batches are cut into runs of about a megabyte, so memory is bounded by a run or
the largest single text.

Nulls and edge cases: a null text is an empty one, which has 64 zero bytes. Equal texts give equal media and features.
An empty table gives an empty result; of other columns only those with the names of the results are replaced.
Media may be any progressive JPEG of one or three components, whatever their sampling.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import jpeg
from tessera.llm.bytescan import runs

UNIT = 64
READ = (
    T.StructType().add("payload_bytes", "long").add("payload_sha256", "string").add("tail_crc32", "long").add("height", "integer").add("width", "integer").add("feature", "string")
)
TENSOR = T.StructType().add("height", "integer").add("width", "integer").add("channels", "integer").add("data", "binary")


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


def _files(column: pa.Array) -> Iterator[list[bytes]]:
    for _, data, offsets in runs(column):
        raw, at = data.tobytes(), offsets.tolist()
        yield [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


@F.arrow_udf(T.BinaryType())
def _stored(texts: pa.Array) -> pa.Array:
    return pa.array([f for group in _files(texts) for f in jpeg.encode([payload(t) for t in group])], pa.binary())


def feature(image: jpeg.Image, tiles: np.ndarray) -> str:
    """Size, and mean and deviation of each channel, from whole-number sums."""
    flat = tiles.reshape(-1, 3)
    n = len(flat)
    total = flat.sum(axis=0, dtype=np.int64)
    squares = np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
    mean, deviation = total / n, np.sqrt(np.maximum(squares * n - total * total, 0)) / n
    return f"{image.width}x{image.height};" + ",".join(f"{x:.4f}" for x in (*mean, *deviation))


@F.arrow_udf(READ)
def _read(media: pa.Array) -> pa.Array:
    rows = []
    for group in _files(media):
        for image, data, tiles in jpeg.decode(group):
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), image.height, image.width, feature(image, tiles)))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(READ)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=READ.names)


@F.arrow_udf(TENSOR)
def _tensor(media: pa.Array) -> pa.Array:
    out = [jpeg.tensor(image, tiles) for group in _files(media) for image, _, tiles in jpeg.decode(group)]
    whole = lambda i: pa.array([x.shape[i] for x in out], pa.int32())
    return pa.StructArray.from_arrays([whole(0), whole(1), whole(2), pa.array([x.tobytes() for x in out], pa.binary())], names=TENSOR.names)


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with the text's JPEG."""
    return docs.withColumn(media, _stored(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def read(stored: DataFrame, media: str = "media", name: str = "decoded") -> DataFrame:
    """stored with the facts of the decoded media: payload length and digests, size and features."""
    return stored.withColumn(name, _read(F.col(media)))


def tensors(stored: DataFrame, media: str = "media", name: str = "tensor") -> DataFrame:
    """stored with the RGB tensor, row by row, one byte a channel."""
    return stored.withColumn(name, _tensor(F.col(media)))
