"""Numeric matrices of MAT files (level 5, plain or compressed variables), as Matlab's save writes them: full or sparse, by name.

A variable is a run of tagged elements: its class and flags, its sizes, its name, and its values column by column, in whatever number
type is smallest. The file is read by one task, a variable at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import qualified
from .matrix import SCHEMA, MatrixError, batch, opened

# Element types and array classes of the format.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, PACKED = 14, 15
SPARSE, FULL = 5, range(6, 16)
HEAD = 128
#: Cells of a batch.
CELLS = 1 << 20


@dataclass
class Variable:
    """A matrix of rows x cols: values column by column; of a sparse one those of `at`, the rows of its cells, and `starts`, where columns start in these."""

    name: str
    rows: int
    cols: int
    values: np.ndarray
    at: np.ndarray | None = None
    starts: np.ndarray | None = None

    def batches(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.values), CELLS):
            n = np.arange(i, min(i + CELLS, len(self.values)))
            rows, cols = (n % self.rows, n // self.rows) if self.at is None else (self.at[n], np.searchsorted(self.starts, n, "right") - 1)
            yield batch(rows, cols, self.values[n])


def elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """Type and content of the elements of a variable; those of up to four bytes are in their own tag."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + -size % 8


def numbers(element: tuple[int, bytes], order: str) -> np.ndarray:
    if element[0] not in NUMBERS:
        raise MatrixError("a variable's values aren't numbers")
    return np.frombuffer(element[1], order + NUMBERS[element[0]])


def variable(data: bytes, order: str) -> Variable | None:
    """A variable's content; None if it isn't a numeric matrix of two dimensions."""
    parts = list(elements(data, order))
    if len(parts) < 3:
        return None
    flags, sizes = int(numbers(parts[0], order)[0]), numbers(parts[1], order).tolist()
    name, kind = parts[2][1].decode("latin-1"), flags & 0xFF
    if len(sizes) != 2 or kind != SPARSE and kind not in FULL:
        return None
    if kind == SPARSE:
        at, starts, values = (numbers(p, order) for p in parts[3:6])
        n = int(starts[-1])
        return Variable(name, *sizes, values[:n].astype(float), at[:n].astype(np.int64), starts.astype(np.int64))
    values = numbers(parts[3], order).astype(float)
    if len(values) != sizes[0] * sizes[1]:
        raise MatrixError(f"{name} has {len(values)} values for {sizes[0]} x {sizes[1]} cells")
    return Variable(name, *sizes, values)


def variables(path: str) -> Iterator[Variable]:
    with opened(path) as f:
        head = f.read(HEAD)
        if len(head) < HEAD or head[126:128] not in (b"IM", b"MI"):
            raise MatrixError(f"{path} is no MAT file of level 5")
        order = "<" if head[126:128] == b"IM" else ">"
        while len(tag := f.read(8)) == 8:
            kind, size = struct.unpack(f"{order}II", tag)
            data = f.read(size)
            if len(data) < size:
                raise MatrixError(f"{path} ends too early")
            if kind == PACKED:
                whole = zlib.decompress(data)
                kind, size = struct.unpack_from(f"{order}II", whole)
                data = whole[8 : 8 + size]
            if kind == MATRIX and (found := variable(data, order)):
                yield found


def read_mat(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The cells (row, col, value) of one variable of a MAT file, counted from 0."""
    path = qualified(spark, path)

    def read(batches):
        for _ in batches:
            found = next((v for v in variables(path) if v.name == name), None)
            if found is None:
                raise MatrixError(f"{path} has no matrix {name}")
            yield from found.batches()

    return spark.range(1).coalesce(1).mapInArrow(read, SCHEMA)


def read_ratings(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Ratings (user, item, value) of a variable with a rating in each row: user, item, value, ids counted from 1."""
    cells = read_mat(spark, path, name).groupBy("row").agg(*[F.max(F.when(F.col("col") == i, F.col("value"))).alias(f"c{i}") for i in range(3)])
    return cells.select((F.col("c0") - 1).cast("long").alias("user"), (F.col("c1") - 1).cast("long").alias("item"), F.col("c2").alias("value"))
