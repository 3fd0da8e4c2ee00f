"""Infilling against the contract in plain Python, and cuts between words and lines."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cladeframe.llm import infilling

SCHEMA = "doc_id long, text string, n int, form string, prefix string, middle string, output string, digest string, h1 string, row_ int"
CLASH = (1, "f", "p", "m", "o", "d", "x", 2)


def texts():
    rnd = random.Random(3)
    letters = "ab \n\té€𝄞ñ<>PSM\r "
    own = ["", " ", "é", "𝄞", "a<P>b", "x<S>", "<M>", "<P", "S><", "ab" * 40_000 + "é" * 50_000, "\n\n\n", "w" * 300_000]
    return own + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def rows():
    said = [(k, t, *CLASH) for k, t in enumerate(texts())]
    return said + [(None, "null id", *CLASH), (None, None, *CLASH), (5, None, *CLASH), said[20], said[20], (-7, "negative", *CLASH), (20, "same id, other text", *CLASH)]


def expected(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, a, b - a, sha(out), sha(text)


def test_contract(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in infilling.infilling_report(df).collect()), key=repr)
    assert got == sorted(((r[0], *expected(r[0], r[1])) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infilling.infilling_report(df.limit(0)).count() == 0


def test_columns_by_one_name_in_the_session(spark, rows):
    narrow = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    made = infilling.infilling_report(narrow)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


@pytest.mark.parametrize("unit, pattern", [("word", r"(?<=[ \t\n\r])(?=[^ \t\n\r])"), ("line", r"(?<=\n)")])
def test_other_units(spark, rows, unit, pattern):
    df = spark.createDataFrame(rows, SCHEMA).where(F.length("text") < 1000)
    made = infilling.fill_in_middle(df, unit=unit, plain=0).withColumn("back", infilling.restored(F.col("output"), F.col("form")))
    want = {(r[0], r[1]) for r in rows if r[1] is not None and len(r[1]) < 1000}
    seen = 0
    for r in made.collect():
        assert (r["doc_id"], r["back"]) in want
        units = [u for u in re.split(pattern, r["back"]) if u]
        assert r["n"] == len(units)
        if r["form"] != "plain":
            ends = {0}
            for u in units:
                ends.add(max(ends) + len(u))
            assert {r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]} <= ends
            assert r["prefix_chars"] == len(r["prefix"]) and r["middle_chars"] == len(r["middle"])
            seen += 1
    assert seen > 200


def test_own_markers_and_seed(spark):
    df = spark.createDataFrame([(k, f"text <P> {k} of some length") for k in range(200)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    made = infilling.fill_in_middle(df, markers=marks, seed="9", plain=0, suffix_first=50)
    told = made.withColumn("back", infilling.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r["back"] == f"text <P> {r['doc_id']} of some length" for r in told)
    assert {r["form"] for r in told} == {"psm", "spm"}
    other = {r["doc_id"]: r["output"] for r in infilling.fill_in_middle(df, markers=marks, plain=0).collect()}
    assert other != {r["doc_id"]: r["output"] for r in told}
