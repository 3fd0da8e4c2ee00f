"""Record operators against DuckDB's answers and worked examples."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cladeframe import queries as R
from cladeframe.functions import text as T
from cladeframe.operators import reports, sequences
from cladeframe.operators.search import Condition as C
from cladeframe.operators.search import Group, predicate, search, text_query

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "None"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return str(float(x))
    return str(x)


@pytest.mark.parametrize("name", sorted(R.SQL))
def test_query_equals_sql(spark, sf, con, name):
    got = R.Q[name](spark, sf)
    want = con.sql(R.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    pick = lambda rows, cols: sorted(tuple(cell(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
    assert pick(got.collect(), got.columns) == pick(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_folding_and_numbers(spark):
    df = spark.createDataFrame([("12abc",), ("Aedes",), (None,), (" -3.5e1x",), ("É",)], "c string")
    assert [r[0] for r in df.select(T.lenient_double(F.col("c"))).collect()] == [12.0, 0.0, None, -35.0, 0.0]
    assert df.select(T.fold(F.lit("AÉÉz"))).first()[0] == "aÉÉz"


def test_conditions(spark):
    df = spark.createDataFrame([(1, "Aedes"), (2, "AEDES x"), (3, None), (4, "É")], "n int, c string")
    ids = lambda *cs: sorted(r["n"] for r in search(df, cs).collect())
    assert ids(C("c", "EQUALS", "aedes")) == [1] and ids(C("c", "NOT_EQUALS", "aedes")) == [2, 4]
    assert ids(C("c", "LIKE", "%x")) == [2] and ids(C("c", "IS_EMPTY")) == [3] and ids(C("n", "BETWEEN", "3", "2")) == [2, 3]
    assert ids(C("n", "EQUALS", 1), C("n", "EQUALS", 2, connector="OR"), C("c", "LIKE", "x")) == [1, 2]
    assert ids(Group((C("n", "EQUALS", 1), C("n", "EQUALS", 2, connector="OR"))), C("c", "LIKE", "x")) == [2]
    assert predicate(df, [C("c", "LIKE", " ")]) is None
    with pytest.raises(ValueError):
        search(df, [C("nosuch", "LIKE", "x")])


def test_text_grammar():
    assert text_query("Panthera Colombia") == ("and", "Panthera", "Colombia")
    assert text_query("one NOT two three") == ("not", "one", ("and", "two", "three"))
    assert text_query("one OR two AND three") == ("or", "one", ("and", "two", "three"))
    assert text_query("a AND NOT b") == ("not", "a", "b")
    assert text_query('"Ara macao"') == "Ara macao" and text_query("()") is None
    assert text_query("AND Panthera") == ("and", "AND", "Panthera")
    assert text_query("Panthera, onca") == ("and", "Panthera", "onca")


@pytest.mark.parametrize(
    ("old", "new", "want"),
    [
        ("Ax1", "Ax1", {"same": 1}), ("Ax1", "Ax2", {"chg": 1}), ("Ax1 Ax1", "Ax1 Ax1 Ax1", {"same": 2, "new": 1}),
        ("Ax1 Ax2", "Ax2 Ax3 Ax4", {"same": 1, "chg": 1, "new": 1}), ("Ax1", "Ay1", {"new": 1, "gone": 1}), ("Ax1", "ax1", {"new": 1, "gone": 1}),
    ],
)
def test_snapshot_cases(spark, old, new, want):
    table = lambda s: spark.createDataFrame([(k, *x) for k, x in enumerate(s.split())], "id int, p string, m string, h string")
    got = reports.snapshot_diff(table(old), table(new), ["p", "m"], "id", "id").groupBy("op").count().collect()
    assert {r["op"]: r["count"] for r in got} == want


def test_golden_values(spark):
    z = spark.createDataFrame([("z", f"u{k}") for k, n in enumerate((10, 5, 2, 1, 1, 1)) for _ in range(n)], "zone string, u string")
    r = sequences.chao1(z, "zone", "u").first()
    assert (r["chao1"], r["coverage"]) == (7.425, 0.855085)
    b = spark.createDataFrame([("a", k) for k in (1, 2, 3, 4)] + [("b", k) for k in (3, 4, 5)], "zone string, u int")
    r = sequences.beta_pairs(b, "zone", "u").first()
    assert (r["sorensen"], r["simpson"], r["nestedness"]) == (0.428571, 0.333333, 0.095238)
    s1 = "ACGT" * 30
    s2 = list(s1)
    s2[0], s2[1], s2[4], s2[10] = "G", "T", "C", "N"
    p = sequences.pair_counts(spark.createDataFrame([("g", 1, s1), ("g", 2, "".join(s2))], "g string, rid int, s string"), "g", "rid", "s")
    r = p.select("sites", "ts", "tv", *[sequences.distance(m).alias(m) for m in ("p", "jc", "k2p")]).first()
    assert (r["sites"], r["ts"], r["tv"]) == (119, 2, 1)
    assert [round(r[m], 9) for m in ("k2p", "jc", "p")] == [0.025699912, 0.025643524, 0.025210084]
    km = spark.range(1).select(T.great_circle_km(F.lit(40.4168), F.lit(-3.7038), F.lit(19.4326), F.lit(-99.1332)).alias("k")).first()["k"]
    assert round(km, 6) == 9062.65361


def test_stops_and_complement(spark):
    df = spark.createDataFrame([("TAATTAATTAAC",), ("nnAC-GU.N",)], "s string")
    a, b = df.select(T.clean_sequence(F.col("s")).alias("c"), *[T.stop_count(F.col("s"), f).alias(f"f{f}") for f in range(3)], T.reverse_complement(F.lit("ACGTRN")).alias("r")).collect()
    assert (a["f0"], a["f1"], a["f2"]) == (1, 1, 0)  # TAA TTA ATT, AAT TAA, ATT AAT before the last codons
    assert b["c"] == "ACGT" and a["r"] == "NYACGT"
