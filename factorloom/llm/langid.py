"""Language identification by compression: zstandard with a raw-content dictionary for each language.

A text belongs to the language whose dictionary shortens it most. Only letters count: both the dictionaries and the
texts are lower-cased and have one space for any run of other characters. Texts are compressed in blocks, all in one way, so that every
block of a long text is as near to the dictionary as the first one, and all of the text counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with, table

#: Training documents a language, at most about so many; characters taken of each, from a place that its hash chooses; bytes of a dictionary. All documents have room.
SAMPLE, EXCERPT, DICTIONARY = 200, 650, 1 << 17
BLOCK, LEVEL = 1 << 13, 6
#: A margin of less than this share of the second smallest size is narrow.
NARROW = 0.005
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    return f" {OTHER.sub(' ', text.lower()).strip()} "


def sampled(docs: DataFrame, learn) -> dict[str, list[str]]:
    """By language, the one with most documents first, excerpts of about SAMPLE documents, chosen by hashes of their ids and texts. Grows with the languages only.

    Rows with the same language, id and text count once.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, SAMPLE / n)) for lang, n in counts.items()], "lang string, share double")
    draw = F.xxhash64("doc_id", "text")
    at = F.pmod(draw, F.lit(1 << 30)) / (1 << 30)
    start = F.pmod(F.shiftright(draw, 30), F.greatest(F.length("text") - EXCERPT + 1, F.lit(1))) + 1
    some = known.join(F.broadcast(shares), "lang").where(at < F.col("share"))
    rows = some.select("lang", at.alias("at"), F.substring("text", start.cast("int"), EXCERPT).alias("text")).distinct().collect()
    out: dict[str, list[str]] = {lang: [] for lang in sorted(counts, key=lambda x: (-counts[x], x))}
    for r in sorted(rows, key=lambda r: (r.lang, r.at, r.text)):
        out[r.lang].append(r.text)
    return {lang: texts for lang, texts in out.items() if texts}


def dictionaries(samples: dict[str, list[str]]) -> dict[str, bytes]:
    """Raw contents: excerpts, one after another, of each language as many as it has up to DICTIONARY. A shorter one shortens texts less, so a rare language can only miss texts of its own."""
    return {lang: "".join(map(letters, texts)).encode()[:DICTIONARY] for lang, texts in samples.items()}


class Sizer:
    """Compressed sizes of a text by language."""

    def __init__(self, contents: dict[str, bytes]):
        self.langs = list(contents)
        dicts = [zstd.ZstdCompressionDict(c, dict_type=zstd.DICT_TYPE_RAWCONTENT) for c in contents.values()]
        how = zstd.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=DICTIONARY, format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0)
        self.by = [zstd.ZstdCompressor(dict_data=d, compression_params=how) for d in dicts]

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.by]

    def alone(self, data: bytes) -> list[int]:
        """The sizes of all different words, each compressed by itself."""
        words = set(data.split())
        return [sum(len(c.compress(b" %b " % w)) for w in words) for c in self.by]


def predicted(sizer: Sizer, text: str | None) -> tuple[str, float, bool]:
    """Language, confidence from 0 to 1, and whether the margin is too narrow to accept it."""
    if text is None or not any(map(str.isalpha, text)) or not sizer.langs:
        return "und", 0.0, True
    data = letters(text).encode()
    sizes = sizer.sizes(data)
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    if len(order) > 1 and sizes[order[0]] == sizes[order[1]]:
        alone = sizer.alone(data)
        order = sorted(order, key=lambda i: (sizes[i], alone[i], i))
    if len(order) == 1:
        return sizer.langs[0], 1.0, False
    first, second = sizes[order[0]], sizes[order[1]]
    margin = (second - first) / max(second, 1)
    return sizer.langs[order[0]], min(1.0, max(0.0, 1 - 2.0 ** (-(second - first) / 2))), margin < NARROW


def identify(docs: DataFrame, contents: dict[str, bytes], keep: list[str]) -> DataFrame:
    """Return the columns `keep` of docs with lang_pred, score and rejected (by margin, or undetermined).

    A text that is null or has no letter is `und` with score 0, and so is every text if no language was learned; equal sizes are
    decided by the sizes of the text's single words, then for the language with more documents. Rows with equal texts get equal results; a text of any length is
    compressed whole; an empty table gives none; columns of `keep` with the names of added ones give way.
    """

    def found(batches: Iterator[pa.RecordBatch]):
        sizer = Sizer(contents)
        for batch in batches:
            rows = [predicted(sizer, t.as_py()) for t in batch.column("text")]
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *new], [*keep, "lang_pred", "score", "rejected"])

    keep = [c for c in keep if c not in ("lang_pred", "score", "rejected")]  # these give way
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(found, schema_with(docs, keep, "lang_pred string, score double, rejected boolean"))


def op10_langid(spark, sf_dir):
    """All documents; learned from those whose crc32 of the id modulo 5 isn't 0."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    contents = dictionaries(sampled(docs, ~held))
    return identify(docs.withColumn("held_out", held), contents, ["doc_id", "held_out"])
