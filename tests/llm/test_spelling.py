"""Spelling variants against every pair of words, and the count of words against plain Python."""

import random
import re
import zlib
from collections import Counter

from cladeframe.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(docs, least_chars=6, least_n=5, slip=199):
    n = Counter()
    for doc_id, text, *_ in docs:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least_chars
    return {w: k for w, k in n.items() if k >= least_n}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(n, ratio=5):
    own, out = sorted(n), {}
    pairs = {w: [x for x in own if abs(len(x) - len(w)) < 2 and near(w, x)] for w in own}
    form = {}
    for w in own:
        best = min(pairs[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    for w in own:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(pairs[w]), n[form[w]] if form[w] else None)
    return out


def told(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_of_dense_words(spark):
    """Few letters, so that all kinds of edits meet; chains of forms; ties; runs of one letter; Latin letters."""
    for seed, letters in ((1, "ab"), (2, "abc"), (3, "aéÿz")):
        rnd = random.Random(seed)
        words = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))): rnd.choice([1, 1, 2, 5, 25, 125, 600, 3000]) for _ in range(350)}
        words |= {"a" * k: 5**k for k in range(1, 9)}
        got = told(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
        assert got == brute(words)
        assert max(x[3] for x in got.values()) > 5


def test_long_words(spark):
    """Words of tens of thousands of characters, alike but for one edit."""
    rnd = random.Random(6)
    long = "".join(rnd.choice("abcdefgh") for _ in range(40_000))
    words = {long: 50, long[:20_000] + long[20_001:]: 5, long[:39_999] + "z": 7, "q" + long: 1, long[:100]: 2}
    assert told(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_report(spark):
    rnd = random.Random(2)
    vocab = ["keeping", "running", "Straße", "ÉTÉSÉTÉS", "étésétés", "x×y÷zabc", "shorts", "tiny"]
    docs = [(k, " ".join(rnd.choice(vocab) if rnd.random() < 0.97 else rnd.choice(vocab)[1:] + "Q" for _ in range(60)) + rnd.choice(["", "9running8keeping_"])) for k in range(400)]
    docs += [(None, "nullid nullid nullid nullid nullid nulled"), (None, None), (5, ""), (5, " \n"), docs[3], docs[3], (9, "k" * 150_000)]
    clash = [(*d, "w", 1, 2, "c", "n") for d in docs]
    df = spark.createDataFrame(clash, "doc_id long, text string, word string, n int, id int, c string, node string")
    want = brute(counted(docs))
    assert told(spelling.spelling_report(df)) == want
    assert any(x[0] for x in want.values())
    assert spelling.spelling_report(df.limit(0)).count() == 0
    every = {r["word"]: r["n"] for r in spelling.count_words(df, 1, 1, None).collect()}
    assert every == counted(docs, 1, 1, None)


def test_real_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute(counted([tuple(r) for r in df.collect()]))
    assert told(spelling.spelling_report(df)) == want


def test_one_word_in_a_third_of_all(spark):
    docs = [(k, "common " * 300 + f"word{'abcdefgh'[k % 8]} comon") for k in range(300)]
    assert told(spelling.spelling_report(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(counted(docs))
