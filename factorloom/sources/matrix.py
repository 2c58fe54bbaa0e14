"""Matrix files as tables: Matrix Market (coordinate and array), sdm, sbm, ddm and csv, each plain or gzipped.

read_matrix(spark, path) gives the cells (row, col, value), counted from 0, of a file or of all matrix files of a folder. Plain files are split: binary
ones by ranges of cells, text by ranges of bytes that begin and end with a line (where a line's number matters, lines are counted first, range by
range); gzipped ones are read as streams, a block at a time. spark.read.format("matrix") does the same but for what needs more than one pass: equal cells aren't
added up, and dense text files are read by one task.

write_matrix(cells, path) writes one file, its cells ordered by column and row: Spark sorts them by ranges, each task renders its range in pieces of the
file, and the commit joins the pieces as streams, as only one writer can write a file in most stores. write_parts(cells, path) writes a folder of
whole matrix files instead, one for each task, with nothing to join.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..storage import file_system, qualified

SCHEMA = "row long, col long, value double"
TYPES = ("mtx", "sdm", "sbm", "ddm", "csv")
#: Cells of a plain binary file, and bytes of a plain text file, for each task; bytes that are read at a time.
CELLS, RANGE, BLOCK = 1 << 22, 1 << 26, 1 << 23


class MatrixError(ValueError):
    """A file that isn't what its name says, or a matrix that a format can't hold."""


def type_of(path: str) -> tuple[str, bool]:
    """Type and whether gzipped, by the file's extension."""
    packed = path.endswith(".gz")
    ext = path.removesuffix(".gz").rpartition(".")[2].lower()
    ext = "mtx" if ext == "mm" else ext
    if ext not in TYPES:
        raise MatrixError(f"unknown matrix type: {path}")
    return ext, packed


def opened(path: str):
    """A file as a binary stream, unpacked."""
    fs, name = file_system(path)
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        raise MatrixError(f"no such file: {path}")
    raw = fs.open_input_file(name)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)


@dataclass
class Head:
    """What stands before the cells. layout: sdm, sbm, ddm, csv, coordinate, pattern or array; body: where the cells start."""

    layout: str
    rows: int
    cols: int
    cells: int
    body: int


def head_of(kind: str, start: bytes) -> Head:
    """Read a head from the first bytes of a file."""
    if kind in ("sdm", "sbm"):
        rows, cols, n = np.frombuffer(start, "<u8", 3).tolist()
        return Head(kind, rows, cols, n, 24)
    if kind == "ddm":
        rows, cols = np.frombuffer(start, "<u8", 2).tolist()
        return Head(kind, rows, cols, rows * cols, 16)
    text = io.BytesIO(start)
    if kind == "csv":
        rows, cols = int(text.readline()), int(text.readline())
        return Head(kind, rows, cols, rows * cols, text.tell())
    banner = text.readline().decode().split()
    if len(banner) != 5 or banner[0] != "%%MatrixMarket" or banner[1].lower() != "matrix":
        raise MatrixError("no Matrix Market banner")
    form, field, symmetry = (x.lower() for x in banner[2:])
    if form not in ("coordinate", "array") or symmetry != "general" or field not in ("real", "pattern") or (form, field) == ("array", "pattern"):
        raise MatrixError(f"not supported: {form} {field} {symmetry}")
    line = text.readline()
    while line and (not line.strip() or line.startswith(b"%")):
        line = text.readline()
    sizes = [int(x) for x in line.split()]
    if len(sizes) != (3 if form == "coordinate" else 2):
        raise MatrixError("no sizes")
    layout = "pattern" if field == "pattern" else form
    return Head(layout, sizes[0], sizes[1], sizes[2] if form == "coordinate" else sizes[0] * sizes[1], text.tell())


def blocks(stream, end: int | None = None) -> Iterator[bytes]:
    """Whole lines, BLOCK bytes at a time; with `end`, up to the line that begins before so many bytes from here."""
    held, left = b"", end
    while True:
        data = stream.read(BLOCK if left is None else max(min(BLOCK, left), 1))
        if not data:
            break
        if left is not None:
            left -= len(data)
            if left <= 0:  # the last line may go on
                data += stream.readline() if not data.endswith(b"\n") else b""
        cut = data.rfind(b"\n") + 1
        if cut:
            yield held + data[:cut]
            held = data[cut:]
        else:
            held += data
        if left is not None and left <= 0:
            break
    if held:
        yield held


def lines_of(head: Head, data: bytes) -> list[bytes]:
    return [x for x in data.splitlines() if head.layout == "csv" or x.strip() and not x.lstrip().startswith(b"%")]


def text_cells(head: Head, data: bytes, line: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cells, from 0, of whole lines of a text file's body, the first of which has the number `line`; and how many lines there were."""
    lines = lines_of(head, data)
    if head.layout == "csv":
        kept = lines[: max(0, head.rows - line)]
        parts = [x.decode().split(",")[: head.cols] for x in kept]
        if any(len(p) < head.cols for p in parts):
            raise MatrixError(f"a row has fewer than {head.cols} cells")
        values = np.array(parts, float).reshape(len(kept), head.cols)
        rows, cols = np.indices(values.shape)
        return rows.ravel() + line, cols.ravel(), values.ravel(), len(lines)
    numbers = np.array(b" ".join(lines).split(), float)
    width = {"coordinate": 3, "pattern": 2, "array": 1}[head.layout]
    if len(numbers) % width:
        raise MatrixError("a cell lacks a number")
    if head.layout == "array":
        at = line + np.arange(len(numbers))
        return at % max(head.rows, 1), at // max(head.rows, 1), numbers, len(numbers)
    cells = numbers.reshape(-1, width)
    rows, cols = cells[:, 0].astype(np.int64) - 1, cells[:, 1].astype(np.int64) - 1
    return rows, cols, cells[:, 2] if width == 3 else np.ones(len(cells)), len(cells)


def inside(rows: np.ndarray, cols: np.ndarray, head: Head) -> None:
    if len(rows) and (rows.min() < 0 or cols.min() < 0 or rows.max() >= head.rows or cols.max() >= head.cols):
        raise MatrixError("a cell lies outside the matrix")


def checked(head: Head, lines: int) -> None:
    """Whether a text file has as many lines as its head says."""
    wanted = head.rows if head.layout == "csv" else head.cells
    if lines < wanted or lines > wanted and head.layout != "csv":
        raise MatrixError(f"{lines} lines of cells; the head says {wanted}")


def batch(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64)), pa.array(cols.astype(np.int64)), pa.array(values.astype(float))], ["row", "col", "value"])


@dataclass
class Part(InputPartition):
    """first and last: cells of a binary file, bytes of a text file's body; last -1: the whole file."""

    path: str
    kind: str
    first: int = 0
    last: int = -1


def files_of(path: str) -> list[str]:
    """A file, or all files of a folder."""
    fs, name = file_system(path)
    if fs.get_file_info(name).type != pafs.FileType.Directory:
        return [path]
    prefix = path.removesuffix(name)
    return sorted(prefix + f.path for f in fs.get_file_info(pafs.FileSelector(name)) if f.is_file and not f.base_name.startswith(("_", ".")))


def parts_of(path: str, kind: str) -> list[Part]:
    head = shape_of(path, kind)
    if path.endswith(".gz"):
        return [Part(path, kind)]
    if kind in ("mtx", "csv"):
        fs, name = file_system(path)
        size = fs.get_file_info(name).size - head.body
        return [Part(path, kind, i, min(i + RANGE, size)) for i in range(0, size, RANGE)] if size > RANGE else [Part(path, kind)]
    return [Part(path, kind, i, min(i + CELLS, head.cells)) for i in range(0, head.cells, CELLS)]


def text_range(part: Part, head: Head):
    """A stream at the first line that begins in a range of bytes, and how many bytes are left of the range; none if no line does."""
    stream = opened(part.path)
    stream.seek(head.body + part.first)
    left = part.last - part.first
    if part.first:
        stream.seek(head.body + part.first - 1)
        left -= len(stream.readline()) - 1
    return stream, left


def text_batches(part: Part, line: int | None = 0) -> Iterator[pa.RecordBatch]:
    """Cells of a text file or of a range of one, whose first line has the number `line`."""
    head = shape_of(part.path, part.kind)
    if part.last < 0:
        stream, left = opened(part.path), None
        stream.read(head.body)
    else:
        stream, left = text_range(part, head)
        if left <= 0:
            return
    total = 0
    for data in blocks(stream, left):
        rows, cols, values, n = text_cells(head, data, line + total)
        inside(rows, cols, head)
        total += n
        yield batch(rows, cols, values)
    if part.last < 0:
        checked(head, total)


def binary_batches(part: Part) -> Iterator[pa.RecordBatch]:
    """Cells of a binary file or of a range of one, CELLS at a time."""
    path, kind = part.path, part.kind
    head = shape_of(path, kind)
    first, last = part.first, head.cells if part.last < 0 else part.last
    places = [(16, "<f8")] if kind == "ddm" else [(24, "<u4"), (24 + 4 * head.cells, "<u4"), *([(24 + 8 * head.cells, "<f8")] if kind == "sdm" else [])]
    # A gzipped file is unpacked once for each section, as they are read side by side.
    streams = [opened(path) for _ in places]
    for stream, (at, of) in zip(streams, places, strict=True):
        stream.seek(at + first * np.dtype(of).itemsize)
    while first < last:
        n = min(CELLS, last - first)
        found = [np.frombuffer(stream.read(n * np.dtype(of).itemsize), of) for stream, (_, of) in zip(streams, places, strict=True)]
        if any(len(x) != n for x in found):
            raise MatrixError(f"{path} ends too early")
        if kind == "ddm":
            at = np.arange(first, first + n)
            yield batch(at % max(head.rows, 1), at // max(head.rows, 1), found[0])
        else:
            rows, cols = (x.astype(np.int64) - 1 for x in found[:2])
            inside(rows, cols, head)
            yield batch(rows, cols, found[2] if kind == "sdm" else np.ones(n))
        first += n


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options.get("type")

    def partitions(self) -> list[Part]:
        out = []
        for path in files_of(self.path):
            kind = self.kind or type_of(path)[0]
            dense = kind == "csv" or kind == "mtx" and shape_of(path, kind).layout == "array"
            out += [Part(path, kind)] if dense else parts_of(path, kind)
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return text_batches(partition) if partition.kind in ("mtx", "csv") else binary_batches(partition)


@dataclass
class Written(WriterCommitMessage):
    """Pieces of a range of cells, in the order of the file's sections; first and last: its major indices."""

    pieces: list[str]
    cells: int
    rows: int
    cols: int
    first: tuple[int, int]
    last: tuple[int, int]


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        kind, packed = type_of(self.path) if not options.get("type") else (options["type"], self.path.endswith(".gz"))
        self.kind, self.packed, self.overwrite = kind, packed or options.get("compression") == "gzip", overwrite
        self.shape = [int(options[c]) if c in options else None for c in ("rows", "cols")]
        self.array = kind in ("ddm", "csv") or kind == "mtx" and options.get("layout", "coordinate") == "array"
        self.dir = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written | None:
        """Dense files get the range's columns (csv: rows) later, when all sizes are known; so cells are stored for them."""
        columns = [[np.asarray(b.column(i)) for i in range(3)] for b in iterator if b.num_rows]
        rows, cols, values = (np.concatenate(x) for x in zip(*columns, strict=True)) if columns else [np.zeros(0, np.int64)] * 3
        if self.kind == "sbm":
            rows, cols, values = (x[values > 0] for x in (rows, cols, values))
        if not len(rows):
            return None
        major, minor = (rows, cols) if self.kind == "csv" else (cols, rows)
        order = np.lexsort((minor, major))
        rows, cols, values, major, minor = (x[order] for x in (rows, cols, values, major, minor))
        fs, name = file_system(self.dir)
        fs.create_dir(name, recursive=True)
        pieces = []
        for data in sections(self.kind, self.array, rows, cols, values):
            pieces.append(f"{name}/{uuid.uuid4().hex}")
            with fs.open_output_stream(pieces[-1], compression=None) as f:
                f.write(data)
        return Written(pieces, len(rows), int(rows[-1] if self.kind == "csv" else rows.max()) + 1, int(cols.max()) + 1, (int(major[0]), int(minor[0])), (int(major[-1]), int(minor[-1])))

    def commit(self, messages: list[Written | None]) -> None:
        fs, name = file_system(self.path)
        if not self.overwrite and fs.get_file_info(name).type != pafs.FileType.NotFound:
            self.abort(messages)
            raise MatrixError(f"{self.path} is there")
        done = sorted((m for m in messages if m), key=lambda m: m.first)
        if any(a.last > b.first for a, b in pairwise(done)):
            self.abort(messages)
            raise MatrixError("the cells aren't ranged by column and row (csv: by row and column); use write_matrix")
        shape = [given if given is not None else max([0, *[getattr(m, c) for m in done]]) for given, c in zip(self.shape, ("rows", "cols"), strict=True)]
        with fs.open_output_stream(name, compression=None) as raw:
            out = gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) if self.packed else raw
            out.write(head_bytes(self.kind, self.array, shape, sum(m.cells for m in done)))
            if self.array:
                for data in dense(self.kind, shape, done, fs):
                    out.write(data)
            else:
                for i in range(len(done[0].pieces) if done else 0):
                    for m in done:
                        with fs.open_input_file(m.pieces[i]) as f:
                            while data := f.read(BLOCK):
                                out.write(data)
            if self.packed:
                out.close()
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, name = file_system(self.dir)
        if fs.get_file_info(name).type != pafs.FileType.NotFound:
            fs.delete_dir(name)


CELL = np.dtype([("row", "<i8"), ("col", "<i8"), ("value", "<f8")])


def sections(kind: str, array: bool, rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> list[bytes]:
    """What sorted cells add to each section of a file; for dense files the cells themselves. Numbers in text files have six significant digits."""
    if array:
        cells = np.empty(len(rows), CELL)
        cells["row"], cells["col"], cells["value"] = rows, cols, values
        return [cells.tobytes()]
    if kind == "mtx":
        return ["".join(f"{r + 1} {c + 1} {v:.6g}\n" for r, c, v in zip(rows.tolist(), cols.tolist(), values.tolist(), strict=True)).encode()]
    found = [(rows + 1).astype("<u4").tobytes(), (cols + 1).astype("<u4").tobytes()]
    return [*found, values.astype("<f8").tobytes()] if kind == "sdm" else found


def head_bytes(kind: str, array: bool, shape: list[int], cells: int) -> bytes:
    if kind in ("sdm", "sbm", "ddm"):
        return np.array(shape if kind == "ddm" else [*shape, cells], "<u8").tobytes()
    if kind == "csv":
        return f"{shape[0]}\n{shape[1]}\n".encode()
    form = "array" if array else "coordinate"
    return f"%%MatrixMarket matrix {form} real general\n{shape[0]} {shape[1]}{'' if array else f' {cells}'}\n".encode()


def dense(kind: str, shape: list[int], done: list[Written], fs: pafs.FileSystem) -> Iterator[bytes]:
    """Lines of a dense file, column by column (csv: row by row), zeros where there is no cell; some lines at a time. Cells outside the sizes are errors."""
    lines, width = (shape[0], shape[1]) if kind == "csv" else (shape[1], shape[0])
    at = 0
    held = np.zeros(0, CELL)
    names = ("row", "col") if kind == "csv" else ("col", "row")

    def rendered(cells: np.ndarray, upto: int) -> bytes:
        block = np.zeros((upto - at, width))
        block[cells[names[0]] - at, cells[names[1]]] = cells["value"]
        if kind == "ddm":
            return block.astype("<f8").tobytes()
        if kind == "csv":
            return "".join(",".join(f"{v:.6g}" for v in line) + "\n" for line in block.tolist()).encode()
        return "".join(f"{v:.6g}\n" for v in block.ravel().tolist()).encode()

    step = max(1, (BLOCK >> 3) // max(width, 1))

    def upto(cells: np.ndarray, end: int) -> Iterator[bytes]:
        nonlocal at
        while at < end:
            to = min(end, at + step)
            cut = np.searchsorted(cells[names[0]], to)
            yield rendered(cells[:cut], to)
            cells, at = cells[cut:], to

    for m in done:
        with fs.open_input_file(m.pieces[0]) as f:
            while data := f.read(BLOCK // CELL.itemsize * CELL.itemsize):
                held = np.concatenate([held, np.frombuffer(data, CELL)])
                if held[names[0]][-1] >= lines or held[names[1]].max() >= width:
                    raise MatrixError("a cell lies outside the matrix")
                whole = int(held[names[0]][-1])  # that line may go on
                cut = np.searchsorted(held[names[0]], whole)
                yield from upto(held[:cut], whole)
                held = held[cut:]
    yield from upto(held, lines)


class MatrixSource(DataSource):
    """format("matrix"); options: type (else by extension), and for writing rows, cols (else by the cells), layout (coordinate or array), compression. Cells to write have to be ranged, as `write_matrix` does."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options, overwrite)


def shape_of(path: str, kind: str | None = None) -> Head:
    """Sizes of a matrix file, from its head."""
    with opened(path) as f:
        start = f.read(1 << 12)
        kind = kind or type_of(path)[0]
        while kind == "mtx" and len(more := f.read(1 << 16)) and start.rstrip(b"\n").rpartition(b"\n")[2][:1] in (b"%", b""):
            start += more  # a long comment
        return head_of(kind, start)


def matrix_shape(path: str) -> tuple[int, int]:
    head = shape_of(path)
    return head.rows, head.cols


def split_text(spark: SparkSession, parts: list[Part]) -> DataFrame:
    """Cells of ranges of text files, each by a task of its own; lines are counted first, range by range, to number them and to see that there are as many as the head says."""
    frame = spark.createDataFrame([(i, p.path, p.kind, p.first, p.last) for i, p in enumerate(parts)], "i long, path string, kind string, first long, last long").repartition(len(parts))

    def counted(batches):
        for b in batches:
            for r in b.to_pylist():
                part, n = Part(r["path"], r["kind"], r["first"], r["last"]), 0
                head = shape_of(part.path, part.kind)
                stream, left = text_range(part, head)
                if left > 0:
                    for data in blocks(stream, left):
                        n += len(b" ".join(lines_of(head, data)).split()) if head.layout == "array" else len(lines_of(head, data))
                yield pa.RecordBatch.from_arrays([pa.array([r["i"]]), pa.array([n])], ["i", "n"])

    found = dict(map(tuple, frame.mapInArrow(counted, "i long, n long").collect()))
    starts, total = {}, {}
    for i, p in enumerate(parts):
        starts[i] = total.get(p.path, 0)
        total[p.path] = starts[i] + found[i]
    for p in {p.path: p for p in parts}.values():
        checked(shape_of(p.path, p.kind), total[p.path])

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                yield from text_batches(Part(r["path"], r["kind"], r["first"], r["last"]), starts[r["i"]])

    return frame.mapInArrow(read, SCHEMA)


def read_matrix(spark: SparkSession, path: str, distinct: bool = True) -> DataFrame:
    """Cells of a matrix file, or of all of a folder. Equal cells of a coordinate or binary matrix add up; in an sdm file they are an error, unless distinct is False."""
    spark.dataSource.register(MatrixSource)
    path = qualified(spark, path)
    files = files_of(path)
    kinds = {type_of(f)[0] for f in files}
    split = [p for f in files if type_of(f)[0] in ("mtx", "csv") for p in parts_of(f, type_of(f)[0])] if kinds & {"mtx", "csv"} else []
    cells = split_text(spark, split) if any(p.last >= 0 for p in split) and all(p.last >= 0 for p in split) and len(kinds) == 1 else spark.read.format("matrix").load(path)
    if kinds & {"sbm"} or "mtx" in kinds and any(shape_of(f).layout != "array" for f in files):
        return cells.groupBy("row", "col").agg(F.sum("value").alias("value"))
    if kinds == {"sdm"} and distinct:
        once = F.when(F.count("*") == 1, F.first("value")).otherwise(F.raise_error(F.lit("duplicate cells in an sdm file")).cast("double"))
        return cells.groupBy("row", "col").agg(once.alias("value"))
    return cells


def ranged(cells: DataFrame, kind: str) -> DataFrame:
    by = ("row", "col") if kind == "csv" else ("col", "row")
    plain = cells.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double"))
    return plain.repartitionByRange(*by).sortWithinPartitions(*by)


def write_matrix(cells: DataFrame, path: str, **options: object) -> None:
    """Write cells (row, col, value) from 0 to one file, by extension."""
    cells.sparkSession.dataSource.register(MatrixSource)
    kind = str(options.get("type") or type_of(path)[0])
    ranged(cells, kind).write.format("matrix").options(**{k: str(v) for k, v in options.items()}).mode("overwrite").save(qualified(cells.sparkSession, path))


def write_parts(cells: DataFrame, folder: str, kind: str = "sdm", rows: int | None = None, cols: int | None = None, packed: bool = False) -> None:
    """Write cells (row, col, value) from 0 to a folder of coordinate files of the whole matrix's sizes, one for each task; `read_matrix` reads them together."""
    if kind not in ("mtx", "sdm", "sbm"):
        raise MatrixError(f"{kind} files hold whole matrices")
    spark = cells.sparkSession
    if rows is None or cols is None:
        most = cells.agg(F.max("row"), F.max("col")).first()
        rows, cols = ((most[i] if most[i] is not None else -1) + 1 if x is None else x for i, x in enumerate((rows, cols)))
    target, shape = qualified(spark, folder), [rows, cols]
    fs, root = file_system(target)
    fs.create_dir(root, recursive=True)

    def written(batches):
        columns = [[np.asarray(b.column(i)) for i in range(3)] for b in batches if b.num_rows]
        if columns:
            r, c, v = (np.concatenate(x) for x in zip(*columns, strict=True))
            if kind == "sbm":
                r, c, v = (x[v > 0] for x in (r, c, v))
            inside(r, c, Head(kind, rows, cols, 0, 0))
            data = b"".join([head_bytes(kind, False, shape, len(r)), *sections(kind, False, r, c, v)])
            fs, root = file_system(target)
            name = f"{uuid.uuid4().hex}.{kind}{'.gz' if packed else ''}"
            with fs.open_output_stream(f"{root}/_{name}", compression=None) as f:
                f.write(gzip.compress(data, mtime=0) if packed else data)
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    # Files of tasks that were repeated keep the name that isn't read.
    for row in ranged(cells, kind).mapInArrow(written, "name string").collect():
        fs.move(f"{root}/_{row.name}", f"{root}/{row.name}")


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    """(row, value) of a dense matrix of one column."""
    if matrix_shape(path)[1] != 1:
        raise MatrixError(f"{path} has more than one column")
    return read_matrix(spark, path).select("row", "value")


def as_vectors(cells: DataFrame, k: int) -> DataFrame:
    """(id, f) from the cells of a K x N matrix: a column each."""
    pairs = F.sort_array(F.collect_list(F.struct("row", "value")))
    return cells.groupBy(F.col("col").alias("id")).agg(pairs.alias("x")).select("id", F.expr("transform(x, p -> p.value)").alias("f")).where(F.size("f") == k)


def as_cells(vectors: DataFrame) -> DataFrame:
    """The cells of a K x N matrix, from (id, f)."""
    return vectors.select(F.posexplode("f").alias("row", "value"), F.col("id").alias("col")).select("row", "col", "value")
