"""The joins under a cut against all pairs, with unknown bases, gaps, short rows, copies, ties and texts that many share."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.operators import similarity


def family(seed, n, width=300, blocks=3):
    """Rows of several kinds: near and far relatives, holes, ends that are missing, scattered unknowns."""
    rnd = random.Random(seed)
    draw = lambda k: "".join(rnd.choice("ACGT") for _ in range(k))
    common = draw(width // 2)
    roots = [common + draw(width - len(common)) for _ in range(blocks)]
    rows = []
    for k in range(n):
        s = list(rnd.choice(roots))
        for _ in range(rnd.choice([0, 0, 1, 2, 5, 9, 14])):
            s[rnd.randrange(width)] = rnd.choice("ACGT")
        kind = rnd.randrange(8)
        if kind == 0:
            a = rnd.randrange(width)
            s[a : a + rnd.randrange(60)] = "-" * len(s[a : a + rnd.randrange(60)])
        elif kind == 1:
            s = s[: rnd.randrange(90, width)]
        elif kind == 2:
            a = rnd.randrange(10, 190)
            s[:a] = "-" * a
        elif kind == 3:
            for i in range(rnd.randrange(9), width, rnd.choice([9, 30, 80])):
                s[i] = rnd.choice("NRY-")
        rows.append((k, rnd.choice(["g1", "g1", "g1", "g2", None]), None if kind == 4 and k % 3 == 0 else "".join(s), rnd.choice(["a", "b", "c", "", None])))
    rows += [(n, *rows[5][1:]), (n + 1, *rows[5][1:]), (n + 2, rows[6][1], rows[6][2], "z"), (n + 3, "g1", "", "a"), (n + 4, "g1", "ACGT", "a"), (n + 5, "g3", rows[7][2], "a")]
    return rows


def distances(rows, least):
    codes = {}
    for r, g, s, _ in rows:
        if g is not None and s is not None:
            x = np.full(400, 4)
            x[: len(s)] = ["ACGT".find(c) if c in "ACGT" else 4 for c in s.upper()]
            codes[r] = (g, x)
    out = {}
    for i, (g, x) in codes.items():
        for j, (h, y) in codes.items():
            if i < j and g == h:
                both = (x < 4) & (y < 4)
                if both.sum() >= least:
                    out[i, j] = ((x != y) & both).sum() / both.sum()
    return out


def groups(nodes, links):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {n: root(n) for n in nodes}


@pytest.fixture(params=[(1, 0.03, 100), (2, 0.02, 100), (3, 0.08, 50), (4, 0.3, 100), (5, 0.0, 100)])
def case(request, spark):
    seed, cut, least = request.param
    rows = family(seed, 400)
    return rows, spark.createDataFrame(rows, "rid long, g string, s string, label string"), cut, least


def test_links(case, monkeypatch):
    rows, df, cut, least = case
    monkeypatch.setattr(similarity, "BLOCK", 40)
    monkeypatch.setattr(similarity, "BINFUL", 100)
    near = [p for p, d in distances(rows, least).items() if d < cut]
    got = {r["rid"]: r["label"] for r in similarity.close_groups(df, F.col("g"), "rid", "s", cut, least).collect()}
    assert got == groups([r[0] for r in rows], near)
    assert cut == 0 or len(set(got.values())) < len(got)


def test_nearest(case, monkeypatch):
    rows, df, cut, least = case
    monkeypatch.setattr(similarity, "BLOCK", 40)
    label = {r[0]: r[3] for r in rows if r[3]}
    want = defaultdict(lambda: [None, None])
    for (i, j), d in distances(rows, least).items():
        if d <= cut and i in label and j in label:
            for a, b in ((i, j), (j, i)):
                if label[a] == label[b]:
                    want[a][0] = d if want[a][0] is None else min(want[a][0], d)
                else:
                    want[a][1] = (d, b) if want[a][1] is None else min(want[a][1], (d, b))
    got = similarity.nearest_within(df, F.col("g"), "rid", "s", F.col("label"), cut, least).collect()
    told = {r["rid"]: (r["own"], r["nn"], r["nn_id"]) for r in got}
    # Of rows that are equal but for their label's other copies the least id stands for all.
    assert told == {r: (own, *(nn or (None, None))) for r, (own, nn) in want.items()}


def test_a_text_that_all_share(spark):
    """Thousands of rows with one core: every segment's text is in a third of the rows or more."""
    rnd = random.Random(9)
    core = "".join(rnd.choice("ACGT") for _ in range(320))
    far = "".join(rnd.choice("ACGT") for _ in range(320))
    rows = []
    for k in range(3000):
        s = list(core if k % 3 else core[:160] + far[160:])
        for _ in range(3):
            s[rnd.randrange(320)] = rnd.choice("ACGT")
        rows.append((k, "g", "".join(s)))
    df = spark.createDataFrame(rows, "rid long, g string, s string")
    got = {r["rid"]: r["label"] for r in similarity.close_groups(df, F.col("g"), "rid", "s", 0.03).collect()}
    assert got == {k: 1 if k % 3 else 0 for k in range(3000)}


def test_nothing(spark):
    df = spark.createDataFrame([], "rid long, g string, s string, label string")
    assert similarity.close_groups(df, F.col("g"), "rid", "s", 0.03).count() == 0
    assert similarity.nearest_within(df, F.col("g"), "rid", "s", F.col("label"), 0.03).count() == 0


def test_own_distance_beyond_the_cut(spark):
    rows = family(7, 200)
    label = {r[0]: r[3] for r in rows if r[3]}
    own = {}
    for (i, j), d in distances(rows, 100).items():
        if i in label and label.get(j) == label[i]:
            for a in (i, j):
                own[a] = min(d, own.get(a, 9))
    df = spark.createDataFrame(rows, "rid long, g string, s string, label string")
    some = df.where("rid % 7 = 0").select("rid")
    got = {r["rid"]: r["own"] for r in similarity.nearest_of_label(df, some, F.col("g"), "rid", "s", F.col("label")).collect()}
    assert got == {r: d for r, d in own.items() if r % 7 == 0} and max(got.values()) > 0.1
