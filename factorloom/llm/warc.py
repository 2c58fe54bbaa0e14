"""WARC archives with a two-level capture index.

Records are gzip members in archive files. The index sorts lines of (reversed-host URL key, capture number, where the record is)
and cuts them into compressed blocks, one after another in index files; at the end of each index file is its sparse directory, the first line's key and the
range of every block. A lookup searches the list of index files, then a file's directory, reads the range of the one block, searches its lines, and
reads the range of the archive that holds the record. Captures of one key are told apart, and dealt to files, by their numbers.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.storage import file_system, scratch_folder

from .common import materialize, table

#: Payloads of fewer bytes are always stored in full.
LEAST = 1000
#: Bytes from which on an archive file is closed.
ARCHIVE = 1 << 26
#: Lines in a block of the index.
BLOCK = 1000
#: Ranges of an archive that lie no further apart are read at once, up to so many bytes.
GAP, READ = 1 << 16, 1 << 23
PLACES = "key string, capture long, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: http://www.Example.com:80/a?b gives com,example,www)/a?b; the empty key for null."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    port = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}"


def record(kind: str, ident: str | None, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has the payload's digest and length, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {urn_of(ident)}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url:
        head.append(f"WARC-Target-URI: {url}".replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn_of(refers)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(["WARC/1.1", *head]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers of a record (names in lower case), its payload, and the payload's length as the HTTP header has it."""
    data = zlib.decompress(member, 31)
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return head, payload, length


def urn_of(ident: str | None) -> str:
    return "<urn:page>" if ident is None else f"<urn:page:{quote(ident, safe='')}>"


def page_of(urn: str | None) -> str | None:
    return unquote(urn.removeprefix("<urn:page:").removesuffix(">")) if urn and urn != "<urn:page>" else None


def archive(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, size: int = ARCHIVE) -> DataFrame:
    """Write a record for every page to archive files in the scratch folder; returns their places (key, capture, archive, offset, length), stored.

    A null html is an empty payload, a null url has the empty key and no header. Of records with equal payloads of at least `least` bytes, the largest id's is a
    response and the others are revisits of it; pages without an id revisit those that have one. Rows that repeat an id with the same payload are alike:
    all are responses if the id is the largest. Payloads of any length are stored whole. An empty table gives no files and no places. Other columns aren't looked at.
    """
    named = pages.select(F.col(ident).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), F.sha1(F.coalesce(html, F.lit("")).cast("binary")).alias("digest"))
    long = F.octet_length("html") >= least
    # Only payloads that occur more than once: mostly few, so that the join seldom has to move the pages.
    latest = materialize(named.where(long).groupBy("digest").agg(F.max("id").alias("latest"), F.count("*").alias("n")).where("n > 1").drop("n"))
    refers = F.when(long & (F.col("id").isNull() | (F.col("id") < F.col("latest"))), F.col("latest"))
    linked = named.join(latest, "digest", "left").select(F.col("id").cast("string").alias("id"), "url", "html", "digest", refers.cast("string").alias("refers"))
    folder = scratch_folder(pages.sparkSession)
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)

    def stored(batches):
        fs, root = file_system(folder)
        out = name = None
        at = 0
        for batch in batches:
            places = []
            for page, link, text, digest, refers in zip(*[batch.column(i) for i in range(5)], strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                payload, link, refers = text.as_buffer().to_pybytes() if text.is_valid else b"", link.as_py(), refers.as_py()
                member = record("response" if refers is None else "revisit", page.as_py(), link, payload, digest.as_py(), refers)
                out.write(member)
                places.append((url_key(link), uuid.uuid4().int >> 65, f"{folder}/{name}", at, len(member)))
                at += len(member)
                if at >= size:
                    out.close()
                    out = None
            yield placed(places)
        if out is not None:
            out.close()

    return materialize(linked.mapInArrow(stored, PLACES))


def placed(places: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    columns = list(zip(*places, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["key", "capture", "archive", "offset", "length"])


FOOT = "<QQ"


@dataclass
class IndexFile:
    """An open index file: its directory, and the block that was read last. `reads` counts the ranges read."""

    path: str
    reads: int = 0
    firsts: list[tuple[str, int]] = field(default_factory=list)
    ranges: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        fs, name = file_system(self.path)
        self.file = fs.open_input_file(name)
        end = self.file.size() - struct.calcsize(FOOT)
        at, size = struct.unpack(FOOT, self.file.read_at(struct.calcsize(FOOT), end))
        for key, capture, offset, length in json.loads(zlib.decompress(self.file.read_at(size, at))):
            self.firsts.append((key, capture))
            self.ranges.append((offset, length))
        self.at, self.lines, self.keys = -1, [], []

    def block(self, i: int) -> None:
        if i != self.at:
            offset, length = self.ranges[i]
            self.lines = [json.loads(x) for x in zlib.decompress(self.file.read_at(length, offset)).decode().split("\n")]
            self.at, self.keys, self.reads = i, [(x[0], x[1]) for x in self.lines], self.reads + 1

    def one(self, key: str, capture: int) -> list | None:
        """The line of one capture."""
        i = bisect_right(self.firsts, (key, capture)) - 1
        if i < 0:
            return None
        self.block(i)
        j = bisect_left(self.keys, (key, capture))
        return self.lines[j] if j < len(self.lines) and self.keys[j] == (key, capture) else None

    def all(self, key: str) -> Iterator[list]:
        """The lines of all captures of a key, block by block."""
        i = max(0, bisect_left(self.firsts, (key, -1)) - 1)
        while i < len(self.firsts) and self.firsts[i][0] <= key:
            self.block(i)
            yield from self.lines[bisect_left(self.keys, (key, -1)) : bisect_left(self.keys, (key, 1 << 63))]
            i += 1


@dataclass
class Index:
    """files: (first key, first capture, path, blocks, lines) of every index file, in order; places: as `archive` returns them."""

    files: list[tuple[str, int, str, int, int]]
    places: DataFrame

    def near(self, key: str, capture: int) -> int:
        """The file that holds a capture, if any does."""
        return max(0, bisect_right([f[:2] for f in self.files], (key, capture)) - 1)


def build_index(places: DataFrame, size: int = BLOCK) -> Index:
    """Sort all places by key and capture into blocks of at most `size` lines. Only a row for each index file comes to the driver."""
    folder = scratch_folder(places.sparkSession)
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)

    def written(batches):
        fs, root = file_system(folder)
        path, out, lines, directory, at, n = f"{uuid.uuid4().hex}.idx", None, [], [], 0, 0

        def cut(lines: list[tuple]) -> None:
            nonlocal at, n
            data = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode())
            out.write(data)
            directory.append((*lines[0][:2], at, len(data)))
            at, n = at + len(data), n + len(lines)

        for batch in batches:
            lines += zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True)
            if lines and out is None:
                out = fs.open_output_stream(f"{root}/{path}", compression=None)
            while len(lines) >= size:
                cut(lines[:size])
                del lines[:size]
        if lines:
            cut(lines)
        if out is not None:
            data = zlib.compress(json.dumps(directory).encode())
            out.write(data + struct.pack(FOOT, at, len(data)))
            out.close()
            yield pa.RecordBatch.from_pylist([{"first": directory[0][0], "capture": directory[0][1], "path": f"{folder}/{path}", "blocks": len(directory), "lines": n}])

    by = ("key", "capture")
    rows = places.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(written, "first string, capture long, path string, blocks long, lines long").collect()
    return Index(sorted(map(tuple, rows)), places)


def lookup(index: Index, url: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """All captures of a URL, headers and payloads, one at a time, by binary search in the list of files, in directories and in blocks. A null url finds the captures without one."""
    key = url_key(url)
    i = index.near(key, -1)
    while i < len(index.files) and index.files[i][0] <= key:
        for _, _, path, offset, length in IndexFile(index.files[i][2]).all(key):
            fs, name = file_system(path)
            with fs.open_input_file(name) as f:
                yield parse(f.read_at(length, offset))[:2]
        i += 1


def found_places(index: Index, wanted: DataFrame) -> DataFrame:
    """The places of captures (key, capture), by search in the index; an error if one isn't there. Neighbours ask for the same block one after another."""
    files = index.files

    def searched(batches):
        own = Index(files, None)
        now = None
        for batch in batches:
            places = []
            for key, capture in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = files[own.near(key, capture)][2]
                if now is None or now.path != path:
                    now = IndexFile(path)
                line = now.one(key, capture)
                if line is None:
                    raise ValueError(f"no capture {capture} of {key}")
                places.append(line)
            yield placed(places)

    by = ("key", "capture")
    return wanted.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(searched, PLACES)


def captures(index: Index, wanted: DataFrame, ident: str, kind) -> DataFrame:
    """The records of captures (key, capture) that the index leads to, read by their ranges: ident, payload_bytes, payload_digest, record_type, refers_to, url_key.

    An error if a payload isn't what its record says. No captures give no rows.
    """

    def pieces(rows: list[tuple]) -> Iterator[list[tuple]]:
        """Neighbours that are read at once."""
        held: list[tuple] = []
        for row in rows:
            if held and (row[1] != held[0][1] or row[2] > held[-1][2] + held[-1][3] + GAP or row[2] + row[3] > held[0][2] + READ):
                yield held
                held = []
            held.append(row)
        if held:
            yield held

    def read(batches):
        open_path = file = None
        for batch in batches:
            rows = []
            for piece in pieces(list(zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True))):
                if piece[0][1] != open_path:
                    open_path = piece[0][1]
                    fs, name = file_system(open_path)
                    file = fs.open_input_file(name)
                start = piece[0][2]
                data = memoryview(file.read_at(piece[-1][2] + piece[-1][3] - start, start))
                for key, _, offset, length in piece:
                    head, payload, n = parse(data[offset - start : offset - start + length])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != n):
                        raise ValueError(f"record {head['warc-record-id']} doesn't have the payload that it names")
                    rows.append((page_of(head["warc-record-id"]), n, digest, head["warc-type"], page_of(head.get("warc-refers-to")), key))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if i == 1 else pa.string()) for i, c in enumerate(columns)], names)

    names = ["id", "payload_bytes", "payload_digest", "record_type", "refers", "url_key"]
    # A piece of an archive is read by one task, in order.
    piece = F.floor(F.col("offset") / READ)
    dealt = found_places(index, wanted).repartition("archive", piece).sortWithinPartitions("archive", "offset").select("key", "archive", "offset", "length")
    rows = dealt.mapInArrow(read, "id string, payload_bytes long, payload_digest string, record_type string, refers string, url_key string")
    return rows.select(F.col("id").cast(kind).alias(ident), *names[1:4], F.col("refers").cast(kind).alias("refers_to"), "url_key")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: archived, indexed, each page's capture looked up in the index, and its record read from its range of an archive. Odd cases are as in `archive`."""
    pages = table(spark, sf_dir, "pages")
    places = archive(pages)
    return captures(build_index(places), places, "page_id", pages.schema["page_id"].dataType)


ORACLE = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, url, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS latest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN latest END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.')), ',') || ')'
         || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) END
         || regexp_extract(url, '^[^?#]*([?][^#]+)?', 1) AS url_key
FROM m
"""
