"""Phrase and proximity matches, and contamination, against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cladeframe.llm import postings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, w string, t int, d int, h int, p int, b int, size int, term string, n_ int, items string, row int"
CLASH = ("w", 1, 2, 3, 4, 5, 6, "t", 7, "i", 8)


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def windows(text, width=10):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(8)
    vocab = ["alpha", "beta", "Gamma", "the", "THE", "of", "été", "É", "x1", "2"] + [f"w{k}" for k in range(60)]
    said = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", ", ", "\n", "-", "'"]) for _ in range(n))
    items = [said(rnd.randrange(10, 40)) for _ in range(25)] + [said(9), said(3), "solo", "two words", "the the the", "", "...", None, "the " * 14]
    items.append(items[0])
    texts = [None, "", "  ", "solo", "Two Words", "É", "é", "the the", "the " * 40, said(20_000)]
    for k in range(120):
        t = said(rnd.randrange(0, 120))
        for _ in range(rnd.randrange(0, 3)):
            w = (items[rnd.randrange(25)]).split(" ")
            t += " " + rnd.choice([" ".join(w).upper(), " ".join(w[3:]), " ".join(w[: len(w) // 2])]) + " " + said(rnd.randrange(5))
        texts.append(t)
    docs = [(k, t, *CLASH) for k, t in enumerate(texts)]
    docs += [docs[20], docs[20], (None, texts[21], *CLASH), (None, None, *CLASH), (22, texts[23], *CLASH)]
    tests = [(f"i{k}", t) for k, t in enumerate(items)] + [(None, items[1]), ("i2", "shared id with w1 w2 w3 w4 w5 w6 w7 w8")]
    return docs, tests, spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(tests, "item_id string, text string")


def brute(docs, tests, width=10):
    of = defaultdict(set)
    for item, text in tests:
        for w in windows(text, width):
            of[w].add(item or "")
    sizes = {len(w) for w in of}
    out = Counter()
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if own := of.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= own
        out[doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


def told(df):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())


def test_contamination(tables):
    docs, tests, df, items = tables
    want = brute(docs, tests)
    assert told(postings.contamination_report(df, items)) == want
    assert sum(r[5] for r in want) > 40 and not all(r[5] for r in want)


def test_empty_tables(tables):
    docs, tests, df, items = tables
    assert postings.contamination_report(df.limit(0), items).count() == 0
    assert told(postings.contamination_report(df, items.limit(0))) == brute(docs, [])


def test_one_hot_passage(spark):
    """A passage in a third of all rows, a hot word, and one document repeated often."""
    rnd = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(30))
    docs = [(k, passage if k % 3 == 0 else " ".join(rnd.choice(["the", "of", f"p{rnd.randrange(30)}"]) for _ in range(30))) for k in range(6000)]
    docs += [(7, "the " * 12)] * 3000
    tests = [(str(k), passage) for k in range(3)] + [("of", "the " * 11)]
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id string, text string")
    assert told(postings.contamination_report(df, items)) == brute(docs, tests)


def test_proximity(spark, tables):
    docs, tests, df, items = tables
    df = df.where(F.length("text") < 2000)
    tests = [("a", "alpha w1 w2"), ("b", "solo"), ("c", "été w3 w3"), ("d", "the of"), ("e", "absent w1")]
    win, _ = postings.windows_of(spark.createDataFrame(tests, "item_id string, text string"))
    vocabulary = postings.vocabulary_of(win)
    index = postings.build_index(df, vocabulary)
    ranked = postings.ranked_words(win, vocabulary, index)
    rare = {r["w"]: r["term"] for r in ranked.where("r = 1").join(vocabulary, "t").collect()}
    terms = {r["w"]: frozenset(r["terms"]) for r in win.collect()}
    span = 9
    want = set()
    for doc_id, text, *_ in {d[:2] for d in docs if d[1] is not None and len(d[1]) < 2000}:
        own = words(text)
        for w, term in rare.items():
            for p in (k for k, x in enumerate(own) if x == term):
                found = []
                for b in range(max(0, p - span + 1), p + 1):
                    e = next((e for e in range(p, min(b + span, len(own))) if terms[w] <= set(own[b : e + 1])), None)
                    if e is not None:
                        found.append((e - b, b, e))
                if found:
                    want.add((w, doc_id, *min(found)[1:]))
    got = postings.proximity_matches(index, ranked, span).collect()
    assert {(r["w"], None if r["d"] == postings.NO_ID else r["d"], r["b"], r["e"]) for r in got} == want
    assert len(want) > 20
