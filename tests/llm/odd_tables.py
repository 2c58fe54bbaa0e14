"""Small tables with every odd case."""

import random

NONSENSE = ("the of and to in re on er th at es or an ly ti ing ble ou ha sh nt wh ea st".split(), "de la que el en los ción mente ra ga do ez ll rr mi bo ie".split())


def prose(r: random.Random, n: int, lang: int = 0) -> str:
    words = ["".join(r.choice(NONSENSE[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return "".join(w + (".\n" if i % 17 == 16 else " ") for i, w in enumerate(words)).strip()


def documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): clean and junk prose, copies, shared passages, personal data, nulls, odd characters, repeated rows."""
    r = random.Random(5)
    rows, shared = [], prose(r, 80)
    for i in range(60):
        lang = i % 2
        text = prose(r, r.randint(5, 150), lang)
        if i % 10 == 3:
            text = " | ".join(text.upper().split()) + "!!! ###"
        if i % 10 == 5:
            text += "\n" + shared
        if i % 10 == 7:
            text += f"\ncall +1 (555) 123-4567, mail a.{i}@mail.example.com or 10.0.{i}.1 4111 1111 1111 1111 token = \"{r.getrandbits(160):040x}\""
        rows.append((i, text, ("en", "es")[lang], f"src{i % 4}" if i % 3 else "big", len(text)))
    long = prose(r, 30000)
    extra = [
        (100, None, "en", "src1", None), (101, "", "en", None, 0), (102, " \t\n\x0b\x0c\r ", None, None, 7), (103, "é 漢字 \U0001f600 Ünï", "es", "ümlaut", 9),
        (104, long, "en", "src2", len(long)), (105, rows[4][1], "en", "big", 1), (106, rows[4][1] + " tail", "en", "big", 1), (107, "x" * 5000, "en", "big", 5000),
        (108, "0123456789" * 500, None, "big", 5000), (109, "...", "en", "big", 3), (None, "no id here at all", "en", "big", 3), (None, None, None, None, None),
        (110, "a\n" * 300, "en", "big", 600), (111, "\n\n\n", "en", "src1", 3), (112, "word", "en", "src3", 4),
    ]
    return rows + extra + [rows[8], rows[8], extra[10]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, docs, clashing=False):
    r = random.Random(6)
    frame = spark.createDataFrame(docs, SCHEMA)
    if clashing:
        for c in "id key size selected lines fp pos row kept score n_lines words token start root text_hash _id more".split():
            frame = frame.selectExpr("*", f"concat('{c}', doc_id) AS `{c}`")
    frame.write.parquet(f"{path}/documents.parquet")
    bench = [(1, docs[0][1] if docs else "x"), (2, docs[0][1] if docs else "x"), (3, "word"), (4, None), (5, ""), (6, "..."), (None, "re on er"), (7, prose(r, 40))] if docs else []
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(d[0], int("|" not in (d[1] or "")), int(i % 7 == 0)) for i, d in enumerate(docs[:50])] + ([(3, None, 1), (None, 1, 0), (9, 1, None)] if docs else [])
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    big = prose(r, 300)
    pages = [(1, "http://a.example.com/x?b=1#f", big), (5, "https://b.example.org", big), (3, None, big), (4, "not a url", None), (6, "http://a.example.com/x?b=1", ""), (7, "http://[", "é" * 499), (8, "http://h", "é" * 500), (9, "http://h", "é" * 500), (None, "http://n", big), (9, "http://h", "é" * 500)] if docs else []
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)
