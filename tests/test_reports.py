"""Quality, term lists, lookups and request rules on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from cladeframe.operators import identify, ingest, lookups, quality, sequences, shape, terms

STOPS = {1: {"TAA", "TAG", "TGA"}, 2: {"TAA", "TAG", "AGA", "AGG"}, 5: {"TAA", "TAG"}, 11: {"TAA", "TAG", "TGA"}}


def brute_translation(seq, code):
    def stops(s, f):
        last = f + (len(s) - f) // 3 * 3 - 3
        return sum(s[i : i + 3] in STOPS[code] for i in range(f, last, 3))

    n = [stops(seq, f) for f in range(3)]
    if min(n) > 0:
        back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        m = [stops(back, f) for f in range(3)]
        if min(m) == 0:
            return -(m.index(0) + 1), 0, True
    return n.index(min(n)) + 1, min(n), False


def test_translation_of_both_strands(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(120):
        seq = "".join(rnd.choice("ACGT" if k % 3 else "ACG") for _ in range(rnd.randrange(50, 90)))
        rows.append((k, seq if k % 2 else seq[::-1].translate(str.maketrans("ACGT", "TGCA")), ("COI-5P", "RBCL", "16S", "", "H3")[k % 5], None, "Chordata" if k % 4 == 0 else None, None))
    df = spark.createDataFrame([*rows, (900, "ACGTN*RY" * 10, "COI-5P", None, None, None), (901, "ACG", None, None, None, None), (902, None, "COI-5P", None, None, None)], "id int, seq string, marker string, class string, phylum string, kingdom string")
    got = {r["id"]: r for r in quality.composition_rows(df, "seq", "marker").collect()}
    assert 901 not in got and 902 not in got
    turned = 0
    for k, seq, marker, _, phylum, _ in rows:
        r = got[k]
        code = {"COI-5P": 2 if phylum else 5, "RBCL": 11, "H3": 1}.get(marker)
        assert r["code"] == code
        if code is None:
            assert r["frame"] is None and r["stops"] is None and not r["reversed"]
        else:
            assert (r["frame"], r["stops"], r["reversed"]) == brute_translation(seq, code)
            turned += r["reversed"]
    assert turned
    assert got[900]["invalid"] == 10 and got[900]["ambiguous"] == 20 and {"ambiguous", "invalid", "many_n", "short"} <= set(got[900]["flags"]) and got[900]["barcode"] is False
    forced = {r["id"]: r["code"] for r in quality.composition_rows(df, "seq", "marker", forced=2).collect()}
    assert forced[2] is None and forced[3] == 2 and forced[1] == 2


def test_better_code_and_usable(spark):
    seq = "ATG" + "AGA" * 40  # stops under code 2 only
    df = spark.createDataFrame([(k, seq, "COI-5P", None, "Chordata", None) for k in range(5)] + [(9, "ACG" * 20, "COI-5P", None, None, None)], "id int, seq string, marker string, class string, phylum string, kingdom string")
    rows = quality.composition_rows(df, "seq", "marker")
    best = quality.better_code(rows).collect()
    if rows.where("stops > 0").count():
        assert best[0]["code"] != 2 and best[0]["cleared"] == best[0]["of"]
    assert {r["reason"]: r["n"] for r in quality.left_out(rows).collect()}.get("short") == 1
    assert quality.usable(rows).where("id = 9").count() == 0


def test_terms(spark):
    t = terms.term_table(spark, ["panthera_leo", "Panthera  leo", "MÉRIDA", "merida", "", None, "x"], taxonomy=True)
    got = {(r["term"], r["value"]) for r in t.collect()}
    assert ("Panthera leo", "Panthera leo") in got and ("Merida", "Mérida") in got and ("Merida", "MÉRIDA") in got and ("X", "X") in got
    assert {a for a, _ in got} == {"Panthera leo", "Merida", "X"}
    df = spark.createDataFrame([(1, "Panthera leo", "Panthera", None), (2, "Panthera leo", "Panthera", "Panthera leo persica"), (3, "Leo", "Leo", None), (4, None, "PANTHERA", None)], "rid int, species string, genus string, sub string")
    own = terms.term_table(spark, ["panthera leo", "Panthera", "panthera leo persica", "leo"], taxonomy=True)
    m = sorted((r["rid"], r["term"]) for r in terms.match_taxa(df, own, "rid", "species", ["genus"], "sub").collect())
    assert m == [(1, "Panthera"), (1, "Panthera leo"), (2, "Panthera"), (2, "Panthera leo"), (2, "Panthera leo persica"), (3, "Leo"), (4, "Panthera")]
    got = {r["term"]: (r["n_values"], r["listed"]) for r in terms.metric_lists(df, spark.createDataFrame([(k, "t") for k in (1, 2, 3, 4)], "rid int, term string"), "rid", ["genus"], most=2).collect()}
    assert got == {"t": (3, "Panthera (2); Leo (1); and 1 more")}


def test_names(spark):
    names = ["Aedes aegypti", "Aedes sp.", "Carollia cf. sowelli", "Carollia brevicauda PS1", "Carollia perspicillata azteca", "Oncorhynchus mykiss x Salmo salar", "Aedes", "", None, "Rana Upper Case", "Rana one Two"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(lookups.species_key(F.col("n"))).collect()]
    assert got == ["Aedes aegypti", None, None, None, "Carollia perspicillata", None, None, None, None, None, None]
    places = spark.createDataFrame([("Peru",), (" Exception - Zoo",), ("",), (None,), ("?",)], "c string")
    assert [r[0] for r in places.select(lookups.no_place(F.col("c"))).collect()] == [False, True, True, True, True]
    ids = spark.createDataFrame([("GBAAY23973-24",), ("x",), (None,)], "p string")
    assert [r[0] for r in ids.select(lookups.project(F.col("p"))).collect()] == ["GBAAY", "", ""]


def test_lineages_and_bins(spark):
    df = spark.createDataFrame([("a", "F1", "P1", "b1"), ("a", "F1", "P1", "b1"), ("a", "F2", "P1", None), ("h", "F3", "P1", "b2"), ("h", "F4", "P2", "b2")], "genus string, family string, phylum string, bin string")
    names = spark.createDataFrame([("a",), ("h",), ("F2",), ("none",), ("P1",)], "name string")
    got = {r["name"]: (r["rank"], r["genus"], r["family"], r["phylum"]) for r in lookups.lineages(df, names, ["genus", "family", "phylum"], "phylum").collect()}
    assert got == {"a": ("genus", "a", "F1", "P1"), "F2": ("family", None, "F2", "P1"), "P1": ("phylum", None, None, "P1")}
    b = lookups.bin_species(df, spark.createDataFrame([("b2",)], "bin string"), "bin", "family", most=1).first()
    assert b["total"] == 2 and [tuple(x) for x in b["species"]] == [("F3", 1)]


def test_concordance(spark):
    rows = [("A a", "b1"), ("A a", "b1"), ("A b", "b2"), ("A b", "b3"), ("A c", "b3"), ("A sp.", "b1"), ("A d", None), (None, "b9"), (None, None)]
    r = lookups.concordance(spark.createDataFrame(rows, "s string, b string"), "s", "b").first().asDict()
    assert r == {"species": 3, "bins": 3, "paired_records": 6, "species_only": 1, "bin_only": 1, "concordant_species": 1, "shared_bins": 1, "split_species": 1}


def test_joined_haplotypes(spark):
    rnd = random.Random(5)
    base = "".join(rnd.choice("ACGT") for _ in range(700))
    other = "".join(rnd.choice("ACGT") for _ in range(500))
    rows = [("s", base[:400]), ("s", base[150:600]), ("s", other), ("t", base[:300]), ("t", base[150:600]), ("s", base[350:700])]
    got = {r["species"]: (r["haplotypes"], r["joined"]) for r in lookups.joined_haplotypes(spark.createDataFrame(rows, "species string, clean string")).collect()}
    assert got == {"s": (4, 2), "t": (2, 2)}


def test_pairs_in_blocks(spark):
    rnd = random.Random(6)
    rows = [("g" if k % 3 else None, k, "".join(rnd.choice("ACGTN-") for _ in range(rnd.randrange(20, 40)))) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, rid long, s string")
    got = {(r["i"], r["j"]): (r["sites"], r["same"], r["ts"], r["tv"]) for r in sequences.pair_counts(df, "g", "rid", "s", block=7).collect()}
    want = {}
    for g, i, a in rows:
        for h, j, b in rows:
            if g and h and i < j:
                both = [(x, y) for x, y in zip(a, b) if x in "ACGT" and y in "ACGT"]
                same = sum(x == y for x, y in both)
                ts = sum(x != y and (x in "AG") == (y in "AG") for x, y in both)
                want[i, j] = (len(both), same, ts, len(both) - same - ts)
    assert got == want


def test_requests(spark):
    df = spark.createDataFrame([("ABC12-01", "COI-5P", "A", None), ("ABD1", "coi-5p", "", None), ("XYZ12345", None, "C", None)], "processid string, marker string, nuc string, none string")
    assert shape.chosen_columns(df, ["nuc", "odd", "processid"], without=("nuc",), optional=("extra",)).columns == ["processid", "extra"]
    assert shape.of_marker(df, "marker", "Coi-5p").count() == 2 and shape.of_marker(df, "marker", "coi-5P", "nuc").count() == 1 and shape.of_marker(df, "marker", "").count() == 1
    assert df.where(shape.text_or_id(F.lit(False), "XYZ12", "processid")).count() == 1 and df.where(shape.text_or_id(F.lit(False), "XYZ", "processid")).count() == 0
    rows, more = shape.capped(df, 2, ["processid"])
    assert rows.count() == 2 and more and not shape.capped(df, 3, ["processid"])[1]
    assert {r["column"]: r["n_values"] for r in shape.category_counts(df, ["marker", "nuc"]).collect()} == {"marker": 2, "nuc": 2}
    assert shape.client_records(spark, [{"a": " x ", "z": 1}, {"a": "", "b": None}], ["a", "b"]).collect() == [("x", None)]
    assert shape.criteria(["a_b", "A  b", ""], []) == [("a b", None)] and shape.criteria(["a", "b"], ["1", "2"]) == [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")]
    spec = shape.report_of({"metrics": [{"column": "c", "count": 1}, {"column": "c", "list": 1}, {"column": "no", "count": 1}, {"column": "d"}], "breakdowns": ["c", "c", "no"], "max_list": "x"}, ["c", "d"])
    assert spec == shape.Report({"c": (True, False)}, ("c",), False, 0)
    assert shape.forced_code("auto") is None and shape.forced_code("11") == 11
    usual = {"species": 0.98, "genus": 0.95, "family": 0.9}
    assert shape.thresholds_of({"genus": 0.97}, usual)["genus"] == 0.97
    for bad in (lambda: shape.forced_code(3), lambda: shape.thresholds_of({"genus": 0.99}, usual), lambda: shape.thresholds_of({"family": 0.2}, usual)):
        with pytest.raises(ValueError):
            bad()
    assert "Physical Plan" in shape.plan_text(df)


def test_qualifiers(spark):
    q = lambda **k: [{"name": n, "value": v} for n, v in k.items()]
    rows = [(1, [{"key": "source", "quals": [{"name": "country", "value": " Peru "}, {"name": "country", "value": "x"}]}, {"key": "tRNA", "quals": q(note="n")}, {"key": "CDS", "quals": q(product="p", gene="COI")}]), (2, [{"key": "gene", "quals": q(product="16S")}]), (3, [])]
    df = spark.createDataFrame(rows, "id int, f array<struct<key:string,quals:array<struct<name:string,value:string>>>>")
    got = {r["id"]: (r["x"]["source"], r["x"]["marker"]) for r in df.select("id", shape.qualifiers(F.col("f")).alias("x")).collect()}
    assert got == {1: ({"country": "Peru"}, "COI"), 2: ({}, "16S"), 3: ({}, "")}


def test_update_is_guarded(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    frame = lambda rows: spark.createDataFrame(rows, "k string, v string")
    rows = [(f"k{i}", f"v{i % 7}") for i in range(100)] + [("k1", "v1")]
    assert ingest.update(frame(rows), root, ["k"]) == (1, {"new": 101})
    assert ingest.update(frame(rows[::-1]), root, ["k"]) == (1, {"same": 101})
    with pytest.raises(ingest.Refused):
        ingest.update(frame(rows[:50]), root, ["k"])
    with pytest.raises(ingest.Refused):
        ingest.update(frame([]), root, ["k"])
    before = {r["id"]: (r["k"], r["v"]) for r in spark.read.parquet(ingest.current_version(spark, root)["path"]).collect()}
    changed = [("k3", "other"), *[r for r in rows if r[0] not in ("k3", "k9")], ("fresh", "x")]
    assert ingest.update(frame(changed), root, ["k"]) == (2, {"same": 99, "chg": 1, "gone": 1, "new": 1})
    after = {r["id"]: (r["k"], r["v"]) for r in spark.read.parquet(ingest.current_version(spark, root)["path"]).collect()}
    assert sorted(after.values()) == sorted(changed)
    assert all(before[i][0] == k for i, (k, v) in after.items() if k != "fresh") and max(after) == max(before) + 1
    assert ingest.update(frame(rows[:50]), root, ["k"], force=True)[0] == 3


def test_stored_index_and_members(spark, tmp_path):
    rnd = random.Random(8)
    root = f"file://{tmp_path}/i"
    bases = ["".join(rnd.choice("ACGT") for _ in range(660)) for _ in range(4)]

    def near(s, n):
        t = list(s)
        for p in rnd.sample(range(len(t)), n):
            t[p] = rnd.choice([b for b in "ACGT" if b != t[p]])
        return "".join(t)

    rows = []
    for b, base in enumerate(bases):
        for k in range(6):
            rows.append((100 * b + k, near(base, 3 * k), f"BIN:{b}" if b < 3 else None, "COI-5P", f"G s{b}", "G", "F"))
    rows += [(900, rows[-1][1], None, "COI-5P", "G s3", "G", "F"), (901, "ACGT", "BIN:0", "COI-5P", "x", "x", "x"), (902, bases[0], "BIN:0", "16S", "x", "x", "x")]
    df = spark.createDataFrame(rows, "rid long, clean string, bin string, marker_code string, species string, genus string, family string")
    assert identify.open_index(spark, root, "coi-5p", "v1") is None
    identify.build_index(df, root, "COI-5P", "v1", ("species", "genus", "family"))
    assert identify.open_index(spark, root, "COI-5P", "v2") is None and identify.open_index(spark, root, "16S", "v1") is None
    entries, words = identify.open_index(spark, root, "coi-5p", "v1")
    held = sorted(r["rid"] for r in entries.collect())
    assert [r for r in held if r < 300] == [0, 100, 200] and [r for r in held if r >= 300] == [300 + k for k in range(6)]
    gap = bases[1][:300] + bases[1][330:]  # needs a gap to be laid over
    queries = spark.createDataFrame([(1, near(bases[0], 12)), (2, gap), (3, "".join(rnd.choice("ACGT") for _ in range(600))), (4, rows[3][1])], "rid long, clean string")
    got = {r["query"]: (round(r["best"], 3), r["level"], r["taxon"]) for r in identify.identify(queries, entries, words, df.where("marker_code = 'COI-5P'")).collect()}
    assert got[3] == (0.0, "none", "") and got[4] == (1.0, "species", "G s0")  # record 3 is found as a member of its BIN
    assert got[2][1:] == ("species", "G s1") and got[2][0] > 0.99
    assert got[1][1:] == ("species", "G s0")
    alone = {r["query"]: r["best"] for r in identify.identify(queries, entries, words).collect()}
    assert alone[4] < 1.0
