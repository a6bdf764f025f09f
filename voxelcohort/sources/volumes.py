"""Volume files to chunk rows, decoded where the file is read.

Supported: NIfTI-1 (``.nii``, ``.nii.gz``) and ``.npy``, of one to four axes. The
fourth axis holds frames, each a volume of its own: its ``path`` ends in ``#`` and
the frame's number when there are several. A file is unpacked slab by slab
along its slowest axis, so a task holds the packed bytes and one slab. Values are
stored as 32-bit floats, whatever the file's type.
"""

from __future__ import annotations

import gzip
import io
import math
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

HEADER_SCHEMA = "path string, shape array<int>, spacing array<double>, unit string"
CHUNK_SCHEMA = f"{HEADER_SCHEMA}, bi int, bj int, bk int, origin array<int>, dims array<int>, data array<float>"

# fixed values: NIfTI-1 data type codes and length units
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
UNITS = {1: "m", 2: "mm", 3: "um"}
HEADER_BYTES, FIRST_DATA_BYTE = 348, 352


@dataclass
class Header:
    shape: tuple[int, int, int]
    frames: int
    spacing: list[float]
    unit: str
    kind: np.dtype
    column_major: bool
    scale: tuple[float, float]

    def names(self, path: str) -> list[str]:
        return [path] if self.frames == 1 else [f"{path}#{t}" for t in range(self.frames)]


def _three(values, fill):
    values = list(values)[:3]
    return values + [fill] * (3 - len(values))


def _nifti_header(raw) -> Header:
    """The header; ``raw`` then stands at the first value. A zero or non-finite slope means unscaled values."""
    head = raw.read(HEADER_BYTES)
    ends = [e for e in "<>" if len(head) == HEADER_BYTES and struct.unpack(e + "i", head[:4])[0] == HEADER_BYTES]
    if not ends:
        raise ValueError("not a NIfTI-1 file")
    end = ends[0]
    dim = struct.unpack(end + "8h", head[40:56])
    pix = struct.unpack(end + "8f", head[76:108])
    offset, slope, inter = struct.unpack(end + "3f", head[108:120])
    axes = [max(int(x), 1) for x in dim[1 : max(dim[0], 1) + 1]]
    begin = int(offset) if math.isfinite(offset) and offset >= HEADER_BYTES else FIRST_DATA_BYTE
    raw.read(begin - HEADER_BYTES)
    scaled = math.isfinite(slope) and slope != 0
    code = struct.unpack(end + "h", head[70:72])[0]
    if code not in TYPES:
        raise ValueError(f"data type {code} is not supported")
    return Header(
        tuple(_three(axes, 1)), math.prod(axes[3:]), _three((float(x) for x in pix[1 : len(axes) + 1]), 1.0), UNITS.get(head[123] & 7, "mm"),
        np.dtype(end + TYPES[code]), True, (slope, inter if math.isfinite(inter) else 0.0) if scaled else (1.0, 0.0),
    )


def _npy_header(raw) -> Header:
    version = np.lib.format.read_magic(raw)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, column_major, kind = read(raw)
    if len(shape) > 4 or kind.hasobject:
        raise ValueError("an array of one to four numeric axes is asked for")
    return Header(tuple(_three(shape, 1)), shape[3] if len(shape) == 4 else 1, [1.0, 1.0, 1.0], "mm", kind, column_major, (1.0, 0.0))


def _slabs(raw, head: Header, edge: int):
    """``(frame, axis, start, values)`` of about ``edge`` planes of the slowest axis."""
    (x, y, z), size = head.shape, head.kind.itemsize
    slope, inter = head.scale

    def values(count):
        got = np.frombuffer(raw.read(count * size), head.kind)
        if len(got) != count:
            raise ValueError("the file ends before its last value")
        return got if (slope, inter) == (1.0, 0.0) else got * slope + inter

    if head.column_major:
        for t in range(head.frames):
            for k in range(0, z, edge):
                depth = min(edge, z - k)
                yield t, 2, k, values(x * y * depth).reshape((x, y, depth), order="F")
    else:
        for i in range(0, x, edge):
            depth = min(edge, x - i)
            slab = values(depth * y * z * head.frames).reshape(depth, y, z, head.frames)
            for t in range(head.frames):
                yield t, 0, i, slab[..., t]


def _opened(path: str, content: bytes):
    raw = io.BytesIO(content)
    if path.endswith(".gz"):
        raw = gzip.GzipFile(fileobj=raw)
    return raw, _npy_header(raw) if path.endswith(".npy") else _nifti_header(raw)


def decode_headers(files: DataFrame) -> DataFrame:
    """Headers of ``(path, content)`` rows, one a frame; the values are not unpacked."""

    def decode(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                _, head = _opened(path, content)
                rows += [(name, list(head.shape), head.spacing, head.unit) for name in head.names(path)]
            yield pd.DataFrame(rows, columns=["path", "shape", "spacing", "unit"])

    return files.select("path", "content").mapInPandas(decode, HEADER_SCHEMA)


def decode_volumes(files: DataFrame, edge: int = 64) -> DataFrame:
    """Chunk rows of ``(path, content)`` rows, one volume a frame."""

    def decode(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                raw, head = _opened(path, content)
                names = head.names(path)
                for frame, axis, start, slab in _slabs(raw, head, edge):
                    rows, base = [], [0, 0, 0]
                    base[axis] = start
                    for i in range(0, slab.shape[0], edge):
                        for j in range(0, slab.shape[1], edge):
                            for k in range(0, slab.shape[2], edge):
                                part = slab[i : i + edge, j : j + edge, k : k + edge]
                                at = [base[0] + i, base[1] + j, base[2] + k]
                                rows.append((names[frame], list(head.shape), head.spacing, head.unit, *[a // edge for a in at], at, list(part.shape), np.ascontiguousarray(part, dtype="f4").ravel()))
                    yield pd.DataFrame(rows, columns=["path", "shape", "spacing", "unit", "bi", "bj", "bk", "origin", "dims", "data"])

    return files.select("path", "content").mapInPandas(decode, CHUNK_SCHEMA)


def read_volumes(spark: SparkSession, path: str, edge: int = 64) -> tuple[DataFrame, DataFrame]:
    """Headers and chunks of all volume files below ``path``; ``volume_id`` is the file's path, with the frame if there are several."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{nii,nii.gz,npy}").load(path)
    return decode_headers(files).withColumnRenamed("path", "volume_id"), decode_volumes(files, edge).withColumnRenamed("path", "volume_id")
