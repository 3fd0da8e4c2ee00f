"""Snapshot differences by passes, against brute force; rows are exchanged once."""

import random
from collections import Counter, defaultdict

from cladeframe.operators import ingest, reports

SHAPE = "p string, m int, v string, h string, id long"


def rows_of(rnd, n, versions):
    return [(rnd.choice(["a", "b", None, "", "c"]), rnd.choice([None, *range(9)]), v := rnd.choice(versions), v, k + 1) for k, n in enumerate(range(n))]


def brute(old, new):
    """Operations by key: copies by number within (key, h), then what is left by number within the key."""
    sides, found = [defaultdict(lambda: defaultdict(list)) for _ in range(2)], []
    for side, rows in zip(sides, (old, new)):
        for p, m, _, h, i in rows:
            side[(p or "", m)][h].append(i)
    for key in {*sides[0], *sides[1]}:
        left = [[], []]
        for h in {*sides[0][key], *sides[1][key]}:
            a, b = (s[key].get(h, []) for s in sides)
            k = min(len(a), len(b))
            found += [("same", x, y) for x, y in zip(a, b)]
            left[0] += a[k:]
            left[1] += b[k:]
        a, b = map(sorted, left)
        k = min(len(a), len(b))
        found += [("chg", x, y) for x, y in zip(a, b)] + [("gone", x, None) for x in a[k:]] + [("new", None, y) for y in b[k:]]
    return Counter(found)


def test_differences(spark, monkeypatch):
    rnd = random.Random(2)
    old, new = rows_of(rnd, 300, "xyz"), rows_of(rnd, 280, "xyzw")
    a, b = (spark.createDataFrame(x, SHAPE) for x in (old, new))
    want = brute(old, new)
    assert {op for op, *_ in want} == {"same", "chg", "gone", "new"}
    for rows in (1 << 25, 100):
        monkeypatch.setattr(reports, "PASS_ROWS", rows)
        diff = reports.snapshot_diff(a, b, ["p", "m"], "id", "id")
        assert Counter(tuple(r) for r in diff.collect()) == want
        after = ingest.next_snapshot(a, b.withColumnRenamed("id", "line"), ["p", "m"], "id", "line", ["p", "m", "v"])
        joined = ingest.snapshot_apply(a.drop("h"), b.withColumnRenamed("id", "line").drop("h"), diff, "id", "line").select(after.columns)
        assert Counter(map(tuple, after.collect())) == Counter(map(tuple, joined.collect()))
        none = a.limit(0)
        assert reports.snapshot_diff(none, b, ["p", "m"], "id", "id").where("op <> 'new'").isEmpty()
        assert ingest.next_snapshot(none, none.withColumnRenamed("id", "line"), ["p", "m"], "id", "line", ["p"]).isEmpty()


def test_rows_are_exchanged_once(spark, sf):
    from cladeframe import queries as Q

    told = Q.snapshot_diff(spark, sf)._jdf.queryExecution().executedPlan().toString()
    rows = [x for x in told.split("\n") if "Exchange hashpartitioning" in x and "(_p#" not in x]  # _p: counts by file
    assert len(rows) == 1 and "SortMergeJoin" not in told, told


def test_parts_of_a_pass_are_of_whole_keys(spark, monkeypatch):
    monkeypatch.setattr(reports, "PASS_ROWS", 10)
    a = spark.createDataFrame([(str(k % 7), k % 3, "x", str(k), k) for k in range(40)], SHAPE)
    parts = reports.diff_passes(a, a, ["p", "m"], "id", "id", ["p", "m"])
    held = [{(r["p"], r["m"]) for r in p.collect()} for p in parts]
    assert len(parts) == 8 and sum(map(len, held)) == len(set().union(*held)) == 21
