"""The pipeline's near-duplicate stage on planted near copies, against brute force."""

import random

import corpus_pipeline
from cladeframe.llm import components, near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w)} if len(w) <= k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_groups(texts):
    """Group number per text."""
    s = [shingles(t) for t in texts]
    up = list(range(len(s)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if len(s[i] & s[j]) >= near_copies.LEAST * len(s[i] | s[j]):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(s))]


def planted(seed=3):
    """Texts with copies of one to nine changed words of about 200, so on both sides of 0.8."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(30):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(150, 250))]
        texts.append(" ".join(base))
        for changes in (1, 3, 5, 7, 9):
            w = list(base)
            for at in rnd.sample(range(len(w)), changes):
                w[at] = rnd.choice(vocabulary)
            texts.append(" ".join(w))
    return [*texts, "", None, "one two", "One  two", "one two three"]


def run(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]


def test_planted_near_copies(spark):
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(planted())]
    groups = brute_groups([r[1] for r in rows])
    least = {}
    for (i, *_), g in zip(rows, groups):
        least.setdefault(g, i)
    assert sorted(run(spark, rows)) == sorted(rows[i] for i in least.values())
    assert 40 < len(least) < len(rows) - 60


def test_crowded_bands(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PAIRS_UP_TO", 3)
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(planted(8))]
    groups = brute_groups([r[1] for r in rows])
    assert len(run(spark, rows)) == len(set(groups))


def test_null_and_repeated_ids_keep_their_texts(spark):
    rnd = random.Random(4)
    text = [" ".join(f"w{rnd.randrange(4000)}" for _ in range(60)) for _ in range(6)]
    near = text[2] + " more"
    rows = [
        (None, text[0], "en", "web", 1), (None, text[1], "en", "web", 1), (None, text[1], "de", "web", 1), (7, text[2], "en", "web", 1),
        (None, near, "en", "web", 1), (5, text[3], "en", "web", 1), (5, text[4], "en", "web", 1), (5, text[4], "en", "web", 1),
        (3, text[4] + " more", "en", "web", 1), (3, text[5], "en", "web", 1),
    ]
    got = run(spark, rows)
    # One row per group of texts, whatever ids they share; an id comes before a null one.
    assert sorted((r[0] or 0, r[1]) for r in got) == sorted([(0, text[0]), (0, text[1]), (7, text[2]), (5, text[3]), (3, text[4] + " more"), (3, text[5])])
    assert sorted(map(str, got)) == sorted(map(str, run(spark, rows[::-1])))


def test_simhash_gives_candidates(spark):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(5000)}" for _ in range(3000)]
    texts = [" ".join(base[:at] + ["changed"] + base[at + 1 :]) for at in range(0, 3000, 100)]
    docs = spark.createDataFrame([(i, bytes([i]), t) for i, t in enumerate(texts)], "doc_id long, row binary, text string")
    keys = {r["doc_id"]: set(r["keys"][:6]) for r in near_copies.signatures(docs).collect()}
    prints = [near_copies.simhash_of(near_copies.shingles_of(near_copies.normal(t))) for t in texts]
    near = [(i, j) for i in range(30) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert near and all(keys[i] & keys[j] for i, j in near)


def test_a_large_group_of_far_variants(spark, monkeypatch):
    """Variants of one text that share keys, most of them too far from each other: not paired with all others."""
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = [rnd.choice(vocabulary) for _ in range(150)]
    texts = []
    for i in range(240):
        w = list(base)
        for at in rnd.sample(range(len(w)), 5 if i % 3 else 2):
            w[at] = rnd.choice(vocabulary)
        texts.append(" ".join(w))
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    counts, verified = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, shingles: (counts.append(pairs.count()), verified(pairs, shingles))[1])
    got = run(spark, rows)
    least = {}
    for i, g in enumerate(brute_groups(texts)):
        least.setdefault(g, i)
    assert sorted(r[0] for r in got) == sorted(least.values()) and len(least) > 100
    assert len(counts) == 2 and counts[1] < 5 * len(rows), counts


def test_prefixes_lose_no_pair(spark, monkeypatch):
    """Sets on both sides of 0.8, of unequal sizes, with shingles that nearly all share; also in small blocks."""
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    rnd = random.Random(9)
    drawn = lambda k: {rnd.randrange(-(1 << 63), 1 << 63) for _ in range(k)}
    sets = [drawn(1), drawn(2)]
    for size in (1, 4, 5, 9, 40, 90):
        base, pool = drawn(size), sorted(drawn(12))
        for _ in range(16):
            gone = set(rnd.sample(sorted(base), rnd.randint(0, size // 4)))
            sets.append((base - gone) | set(rnd.sample(pool, rnd.randint(0, min(12, size // 4)))))
    texts = spark.createDataFrame([(i, sorted(x), i) for i, x in enumerate(sets)], "norm long, s array<long>, label long")
    got = {tuple(r) for r in near_copies.prefix_pairs(texts).collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    exact = {(i, j) for i, j in want if 5 * len(sets[i] & sets[j]) == 4 * len(sets[i] | sets[j])}
    assert want <= got and len(want) > 100 and exact and len(got) < len(sets) * (len(sets) - 1) // 4
    one = spark.createDataFrame([(i, sorted(x), 0) for i, x in enumerate(sets)], "norm long, s array<long>, label long")
    assert near_copies.prefix_pairs(one).isEmpty() and near_copies.prefix_pairs(texts.limit(0)).isEmpty()


def test_stars_take_no_round(spark):
    """Edges that are stars already are returned as they are; a path is settled."""
    stars = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "a long, b long")
    assert sorted(map(tuple, components.connected(stars, most_rounds=1).collect())) == [(1, 1), (2, 2), (5, 1), (6, 1), (7, 2)]
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r["label"] for r in components.connected(path).collect()} == {0}
    none = spark.createDataFrame([], "a long, b long")
    assert components.connected(none).isEmpty()


def test_pairs_that_share_no_key(spark, monkeypatch):
    """The keys only save work: near copies that none of them brings together are found by their first shingles."""
    import numpy as np

    for name in ("simhash_keys", "band_keys"):
        monkeypatch.setattr(near_copies, name, lambda s: np.empty(0, np.uint64))
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(planted(12))]
    least = {}
    for i, g in enumerate(brute_groups([r[1] for r in rows])):
        least.setdefault(g, i)
    assert sorted(r[0] for r in run(spark, rows)) == sorted(least.values()) and len(least) < len(rows) - 60


def test_rows_of_the_main_label_do_not_meet(spark):
    """A large group of one label that shares shingles with a few others meets these, not itself."""
    shared = list(range(1, 11))
    sets = [(i, sorted([*shared, 1000 + i]), 0) for i in range(300)] + [(300 + i, sorted([*shared, 5000 + i]), 300 + i) for i in range(3)]
    got = {tuple(r) for r in near_copies.prefix_pairs(spark.createDataFrame(sets, "norm long, s array<long>, label long")).collect()}
    assert got == {(i, j) for j in range(300, 303) for i in range(j)}
