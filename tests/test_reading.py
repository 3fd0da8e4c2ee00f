"""Sequences read on Arrow batches, and record views that store no sequence."""

import random

from pyspark.sql import functions as F

from cladeframe.functions.text import STOPS, clean_sequence
from cladeframe.operators import quality, reading
from cladeframe.plans import records as R

_TURN = str.maketrans("ACGTRYKMBVDH", "TGCAYRMKVBHD")


def _by_hand(s, code):
    frames = lambda x, c: [sum(x[p : p + 3] in STOPS[c] for p in range(f, len(x) - 5, 3)) for f in range(3)]
    back = s.translate(_TURN)[::-1]
    clears = sum((min(frames(s, c)) == 0 or min(frames(back, c)) == 0) << k for k, c in enumerate(STOPS))
    if code is None:
        return None, None, False, None, None, clears
    ahead = frames(s, code)
    least = min(ahead)
    turned = least > 0 and min(frames(back, code)) == 0
    f = frames(back, code).index(0) if turned else ahead.index(least)
    third = [b for b in (back if turned else s)[f:][2::3] if b in "ACGT"]
    return (-(f + 1) if turned else f + 1), 0 if turned else least, turned, len(third), sum(b in "GC" for b in third), clears


def test_sequences_are_read_as_by_hand(spark):
    rng = random.Random(3)
    bases = ["ACGT", "ACGTN", "ACG", "ACGTRYKMSWBDHVN*é"]
    rows = [(k, "".join(rng.choice(rng.choice(bases)) for _ in range(rng.choice([0, 1, 2, 5, 6, 40, 300]))), rng.choice([None, *STOPS])) for k in range(400)]
    rows += [(900, " nn-ac.guTT\tAégN", 1), (901, None, 5), (902, "NNN", 5)]
    df = spark.createDataFrame(rows, "id int, s string, code int").repartition(3)
    got = {r["id"]: r for r in reading.read_sequences(df, "s", "code", 1).join(df.select("id", clean_sequence(F.col("s")).alias("own")), "id").collect()}
    assert {k for k, s, _ in rows if s and s.upper().strip("N- .")} == set(got)
    for k, _, code in rows:
        if k in got:
            r = got[k]
            assert r["clean"] == r["own"] and r["length"] == len(r["own"])
            assert [r[b.lower()] for b in "ACGTN"] == [r["own"].count(b) for b in "ACGTN"]
            assert (r["frame"], r["stops"], r["reversed"], r["third"], r["third_gc"], r["clears"]) == _by_hand(r["own"], code)


def test_composition_without_texts_is_the_same(spark):
    df = spark.createDataFrame([(1, "ACGT" * 30, "COI-5P"), (2, "TAA" * 40, "rbcL"), (3, "AC", "COI-5P")], "id int, seq string, marker string").selectExpr("*", "'' AS class", "'' AS phylum", "'' AS kingdom")
    whole = quality.composition_rows(df, "seq", "marker")
    slim = quality.composition_rows(df, "seq", "marker", texts=False)
    assert set(whole.columns) - set(slim.columns) == {"seq", "clean", "read"}
    assert sorted(map(str, whole.select(*slim.columns).collect())) == sorted(map(str, slim.collect()))


def test_record_views_store_no_sequence_by_row(spark, sf):
    """A sequence is stored once for all records of its kind, and made of what the SQL makes it of."""
    rows = R._lines(spark, sf)
    assert "nuc" not in rows.columns
    own = R.records(spark, sf)
    kinds = rows.select("kind").distinct().count()
    assert kinds <= 24 * 120 * 5 and own.count() == rows.count()
    some = own.where("rid % 37 = 0").select("rid", "nuc")
    t = R._bound(spark, R.record_sql("true", "rid", "pk, sk, rf FROM lineitem", R._RAW), R._tables(spark, sf) | {"lineitem": rows.where("rid % 37 = 0").select("rid", "pk", "sk", "rf")})
    assert some.exceptAll(t.select("rid", "nuc")).isEmpty() and some.count() == t.count()
