"""Ogg media columns: pages with checksums, packets from lacing values, logical streams, timestamps from granule positions."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

HEAD, HEAD_SIZE = "<4sBBqIIIB", 27
CONTINUED, FIRST, LAST = 1, 2, 4
#: The streams that `encode` writes carry 8-bit samples, this many a second, in packets of so many.
RATE, PACKET = 8000, 8192
IDENT = "<8sII"
MAGIC = b"\x7fPCM-U8\x00"
SERIALS = (1, 2)
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """The page checksum (polynomial 0x04c11db7, not reflected, starting from 0), by way of the reflected CRC of zlib."""
    state = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{state:032b}"[::-1], 2)


@dataclass
class Writer:
    """Cuts the packets of one logical stream into pages."""

    serial: int
    number: int = 0
    lacing: list[int] = field(default_factory=list)
    body: list[bytes] = field(default_factory=list)
    granule: int = -1
    open_packet: bool = False

    def page(self, flags: int = 0) -> bytes:
        flags |= (FIRST if self.number == 0 else 0) | (CONTINUED if self.open_packet else 0)
        head = lambda crc: struct.pack(HEAD, b"OggS", 0, flags, self.granule, self.serial, self.number, crc, len(self.lacing)) + bytes(self.lacing)
        body = b"".join(self.body)
        out = head(checksum(head(0) + body)) + body
        self.number, self.granule = self.number + 1, -1
        self.open_packet = bool(self.lacing) and self.lacing[-1] == 255
        self.lacing.clear(), self.body.clear()
        return out

    def packet(self, data: bytes, granule: int) -> list[bytes]:
        """Add a packet that ends at a granule position; returns the pages that it fills."""
        full, at = [], 0
        while True:
            if len(self.lacing) == 255:
                full.append(self.page())
            size = min(255, len(data) - at)
            self.lacing.append(size)
            self.body.append(data[at : at + size])
            at += size
            if size < 255:
                self.granule = granule
                return full


def encode(payload: bytes) -> bytes:
    """Store bytes as 8-bit samples of two logical streams that take turns, packet by packet; granules count a stream's own samples."""
    streams = [Writer(s) for s in SERIALS]
    out = []
    for w in streams:
        w.packet(struct.pack(IDENT, MAGIC, RATE, len(payload)), 0)
        out.append(w.page())
    for i, at in enumerate(range(0, len(payload), PACKET)):
        data = payload[at : at + PACKET]
        out += streams[i % 2].packet(data, i // 2 * PACKET + len(data))
    return b"".join([*out, *[w.page(LAST) for w in streams]])


@dataclass
class Packet:
    serial: int
    number: int
    data: bytes
    granule: int | None  # at the packet's end


@dataclass
class Container:
    packets: list[Packet]
    pages: int
    bad_pages: int
    gaps: int


def demultiplex(media: bytes, samples=len) -> Container:
    """All whole packets of all logical streams, in page order within each stream.

    Pages with a wrong checksum, and bytes that belong to no page, are passed over; a packet that a lost page had a part of is left out,
    and `gaps` counts missing page numbers. A page's granule position is that of the last packet that ends on it; those
    of the others there follow from the packets' numbers of samples.
    """
    out, pages, bad, gaps, at = [], 0, 0, 0, media.find(b"OggS")
    parts: dict[int, list[bytes] | None] = {}
    numbers: dict[int, int] = {}
    counts: dict[int, int] = {}
    while at >= 0 and at + HEAD_SIZE <= len(media):
        _, version, flags, granule, serial, number, crc, n = struct.unpack_from(HEAD, media, at)
        start = at + HEAD_SIZE + n
        lacing = media[at + HEAD_SIZE : start]
        end = start + sum(lacing)
        page = media[at:end]
        if version or end > len(media) or len(lacing) < n or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad += 1
            at = media.find(b"OggS", at + 1)
            continue
        pages += 1
        if number != numbers.get(serial, -1) + 1:
            gaps += 1
            parts[serial] = None
        numbers[serial] = number
        if not flags & CONTINUED:
            parts[serial] = []
        done, spot = [], start
        for size in lacing:
            held = parts.get(serial)
            if held is not None:
                held.append(media[spot : spot + size])
            spot += size
            if size < 255:
                if held is not None:
                    done.append(b"".join(held))
                parts[serial] = []
        ends = granule if granule >= 0 else None
        found = []
        for data in reversed(done):
            found.append((data, ends))
            ends = None if ends is None else max(0, ends - samples(data))
        for data, when in reversed(found):
            counts[serial] = counts.get(serial, -1) + 1
            out.append(Packet(serial, counts[serial], data, when))
        at = end if media[end : end + 4] == b"OggS" else media.find(b"OggS", end)
    return Container(out, pages, bad, gaps)


def decode(media: bytes) -> tuple[bytes, str]:
    """What `encode` stored, and features of the container and of the samples; ValueError if it can't be read whole."""
    found = demultiplex(media)
    heads = [p for p in found.packets if p.number == 0]
    if not heads or found.bad_pages or found.gaps:
        raise ValueError("broken container")
    _, rate, total = struct.unpack(IDENT, heads[0].data)
    # Pages hold many packets of one stream; when a packet starts, and then its stream, says where it belongs.
    body = sorted((p for p in found.packets if p.number), key=lambda p: (p.granule - len(p.data), p.serial))
    payload = b"".join(p.data for p in body)
    if len(payload) != total:
        raise ValueError("broken container")
    x = np.frombuffer(payload, np.uint8)
    level = x.astype(np.int64).sum()
    above = x >= 128
    power = np.bincount(x, minlength=256) @ (np.arange(256) ** 2)
    facts = {
        "streams": len({p.serial for p in found.packets}), "pages": found.pages, "packets": len(body), "rate": rate, "ms": len(x) * 1000 // rate,
        "sum": level, "power": power, "crossings": int((above[1:] != above[:-1]).sum()), "low": x.min(), "high": x.max(),
    }
    return payload, ";".join(f"{k}={v}" for k, v in facts.items())


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (64 - len(text) % 64 if len(text) % 64 or not text else 0)


def stored_features(docs: DataFrame) -> DataFrame:
    """Store each row's text as an Ogg container, read it back and describe it; the columns of op1_ogg.

    A null or empty text is 64 zero bytes; a text of any length is stored whole, in as many pages as it takes; equal texts give equal rows but for doc_id,
    null and repeated ids are as good as others; an empty table gives none; other columns aren't looked at.
    """

    def described(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                media = encode(padded(data))
                payload, feature = decode(media)
                rows.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = [pa.array(list(c)) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[c.cast(t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", *names])

    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    ident = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ident}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(described, schema)


def packets(media: DataFrame, ident: str, column: str, rate: int = RATE) -> DataFrame:
    """One row for each packet of the Ogg containers in a binary column: serial, packet, data, granule, ends_at (seconds), bad_pages, gaps.

    Null, empty and foreign values have no packets. A packet without a granule position has no time.
    """

    def listed(batches):
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                found = demultiplex(value.as_py() or b"")
                rows += [(key.as_py(), p.serial, p.number, p.data, p.granule, None if p.granule is None else p.granule / rate, found.bad_pages, found.gaps) for p in found.packets]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = media.schema[ident].dataType
    names = [ident, "serial", "packet", "data", "granule", "ends_at", "bad_pages", "gaps"]
    kinds = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    return media.select(ident, column).mapInArrow(listed, f"`{ident}` {kind.simpleString()}, serial long, packet long, data binary, granule long, ends_at double, bad_pages long, gaps long")


def op1_ogg(spark, sf_dir):
    """All documents as Ogg media."""
    return stored_features(table(spark, sf_dir, "documents"))
