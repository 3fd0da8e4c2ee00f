"""Ingest, files, distances, networks, trees, structure and identification against brute force and worked examples."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import names as N
from cladeframe.operators import distances, diversity, graph, identify, ingest, reports, sequences, trees
from cladeframe.sources import files, sinks
from cladeframe.streaming import feeds


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("MÃ©rida", "Merida"), ("Belém", "Belem"), ("Bømlo", "Bomlo"), ("Südpfalz", "Sudpfalz"), ("a b é", "a b e"), ("Hawai’i é", "Hawai'i e"),
        ("北京", "北京"), (" Peru ", "Peru"), ("Straße", "Strasse"), ("", ""), (None, None),
    ],
)
def test_normalize_text(spark, raw, want):
    assert one(spark, raw, N.normalize_text) == want


def test_names(spark):
    got = [one(spark, s, N.provisional) for s in ("Carollia sp.", "Carollia cf. brevicauda", "Aedes x3", "Carollia perspicillata", "Abra Capo Xyz", "a x b")]
    assert got == [True, True, True, False, True, True]
    assert one(spark, "ara_macao  Sub", N.taxon_term) == "Ara macao Sub" and one(spark, "Ara macao", N.epithet) == "macao"
    assert tuple(one(spark, "[-0.65, -76.45]", N.coordinates)) == (-0.65, -76.45) and one(spark, "[95, 1]", N.coordinates) is None
    assert spark.range(1).select(N.grid_zone(F.lit(12.5), F.lit(-76.45)).alias("z")).first()["z"] == "12°N 77°W"
    codes = spark.createDataFrame([("COI-5P", None, "Chordata", None), ("COI-5P", "Ascidiacea", "Chordata", None), ("rbcL", None, None, None), ("ITS", None, None, None), ("COI-5P", None, None, None)], "m string, c string, p string, k string")
    assert [r[0] for r in codes.select(N.genetic_code(*[F.col(x) for x in "mcpk"])).collect()] == [2, 13, 11, None, 5]


def test_gc3(spark):
    assert one(spark, "AAGAACAANAAT", lambda c: sequences.gc3(c, 0)) == 66.67
    assert one(spark, "NNN", lambda c: sequences.gc3(c, 0)) is None


def test_ingest_cases(spark):
    lines = ["P1\tNone\tac-gt", "P2\t\t---", "P3\tx\tn-n", "P4\tx", "", 'P5\t1"x\tACGT', "P1\tBømlo\tACGT", "P1\tBømlo\tACGT", "P6\tx\tACGT\tmore"]
    df = ingest.classify_lines(spark.createDataFrame([(x,) for x in lines], "value string"), {"processid": 0, "species": 1, "nuc": 2}, "nuc")
    assert {r["fate"]: r["lines"] for r in ingest.ingest_counts(df).collect()} == {"kept": 5, "no_seq": 1, "only_n": 1, "malformed": 1, "blank": 1}
    kept = sorted((r["processid"], r["species"] or "", r["nuc"]) for r in df.where("fate = 'kept'").collect())
    assert kept == [("P1", "", "ACGT"), ("P1", "Bomlo", "ACGT"), ("P1", "Bomlo", "ACGT"), ("P5", '1"x', "ACGT"), ("P6", "x", "ACGT")]
    assert ingest.ingest_counts(df.limit(0)).count() == 0


def test_resolve_fields():
    r = files.resolve_fields(["nuc", "country_ocean", "ProcessID", "habitats", "nuc"], ["processid", "country/ocean", "nuc", "habitat", "genus"], ["genus"])
    assert r["places"] == {"processid": 2, "country/ocean": 1, "nuc": 0} and r["missing_required"] == ["genus"]
    assert r["added"] == ["habitats"] and r["hints"] == {"habitat": "habitats"}


def test_numbered_and_versions(spark, tmp_path):
    df = spark.createDataFrame([(x,) for x in random.Random(3).sample(range(1000), 300)], "v long")
    got = ingest.numbered(df, ["v"], "n", 10).orderBy("v").collect()
    assert [r["n"] for r in got] == list(range(11, 311))
    root = f"file://{tmp_path}/store"
    assert ingest.current_version(spark, root) is None
    assert ingest.publish(df, root, 300) == 1 and ingest.publish(df.limit(5), root) == 2
    with pytest.raises(ValueError):
        ingest.publish(df, root, 299)
    assert tuple(ingest.current_version(spark, root))[:2] == (2, 5)  # the refused one is not listed


def test_snapshot_apply(spark):
    old = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (3, "B", "z")], "rid long, p string, h string")
    new = spark.createDataFrame([(1, "C", "n"), (2, "A", "x"), (3, "A", "w")], "line long, p string, h string")
    diff = reports.snapshot_diff(old, new, ["p"], "rid", "line")
    assert sorted(tuple(r) for r in ingest.snapshot_apply(old, new, diff, "rid", "line").collect()) == [(1, "A", "x"), (2, "A", "w"), (4, "C", "n")]


@pytest.mark.parametrize(
    ("header", "want"),
    [
        ("P1|S1|BOLD:AAA1|Genus_epithet|COI-5P", ("P1", "Genus epithet", "BOLD:AAA1", "COI-5P")), ("P1|S1||Genus_epithet|COI-5P", ("P1", "Genus epithet", "", "COI-5P")),
        ("P1|Genus epithet|COI-5P|ACC1", ("P1", "Genus epithet", None, "COI-5P")), ("P1|BOLD:AAA1|Genus_epithet|COI-5P", ("P1", "Genus epithet", "BOLD:AAA1", "COI-5P")),
        ("MN1.1 Carollia perspicillata voucher X", ("MN1.1", "Carollia perspicillata", None, None)), ("Carollia_perspicillata_ABC123", ("Carollia_perspicillata_ABC123", "Carollia perspicillata", None, None)),
        ("X1 Carollia cf. brevicauda", ("X1", "Carollia cf. brevicauda", None, None)), ("X1 Carollia sp. ROM 1", ("X1", "Carollia sp.", None, None)),
        ("X1 Diptera voucher ROM 1", ("X1", None, None, None)), ("P1|Rhogeessa aeneus|X", ("P1", None, None, None)),
    ],
)
def test_headers(spark, header, want):
    r = files.parse_headers(spark.createDataFrame([(header,)], "header string")).first()
    assert (r["id"], r["species"], r["bin"], r["marker"]) == want


def test_fasta_round_trip(spark, tmp_path):
    rows = [("P1", "S1", None, "Ara macao", "COI-5P", "A" * 60), ("P2", None, "BOLD:A", None, None, "nnAC-GT"), ("P3", None, None, "Ara", "ITS", "acgu" * 20)]
    df = spark.createDataFrame(rows, "p string, s string, b string, sp string, m string, q string")
    sinks.write_fasta(df, sinks.fasta_entry("p", "s", "b", ["sp"], "m", "q"), f"file://{tmp_path}/out")
    got = {r["header"]: r["sequence"] for r in files.read_fasta(spark, f"file://{tmp_path}/out").collect()}
    assert got == {"P1|S1||Ara_macao|COI-5P": "A" * 60, "P3|||Ara|ITS": "ACGT" * 20}
    sinks.write_table(df, f"file://{tmp_path}/csv", names={"p": "Record"})
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).columns[0] == "Record"
    sinks.write_terms(df, "p", f"file://{tmp_path}/terms")
    assert {p.name for p in (tmp_path / "terms").glob("_term=*")} == {"_term=P1", "_term=P2", "_term=P3"}
    (tmp_path / "raw.tsv").write_text('a\tb\n1"x\t2\n')
    header, lines = files.raw_lines(spark, f"file://{tmp_path}/raw.tsv")
    assert header == ["a", "b"] and [r[0] for r in lines.collect()] == ['1"x\t2']


def brute_components(nodes, edges):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 240)]
    nodes = list(range(120)) + list(range(200, 241))
    got = graph.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == brute_components(nodes, edges)


def test_spanning_network(spark):
    rng = random.Random(2)
    pairs = [(a, b, rng.randrange(1, 5)) for a, b in itertools.combinations(range(9), 2)]
    want = {(a, b, d) for a, b, d in pairs if (lab := brute_components(range(9), [(x, y) for x, y, e in pairs if e < d]))[a] != lab[b]}
    got = graph.spanning_network(spark.createDataFrame([(n,) for n in range(9)], "node long"), spark.createDataFrame(pairs, "a long, b long, d long"))
    assert {tuple(r) for r in got.collect()} == want


def test_tree_of_additive_distances(spark):
    # ((0:1, 1:2):3, (2:4, 3:5)): neighbours 0 and 1, 2 and 3; inner edge 3
    d = {(0, 1): 3, (0, 2): 8, (0, 3): 9, (1, 2): 9, (1, 3): 10, (2, 3): 9}
    rows = trees.neighbour_trees(spark.createDataFrame([("g", i, j, float(v)) for (i, j), v in d.items()], "g string, i long, j long, d double"), "g").collect()
    assert {r["rid"]: r["length"] for r in rows if r["rid"] is not None} == {0: 1.0, 1: 2.0, 2: 4.0, 3: 5.0}
    assert [r["length"] for r in rows if r["rid"] is None] == [3.0]


def test_suspects_and_shared(spark):
    rec = spark.createDataFrame(
        [(1, "Aa bb", "Aa", "X"), (2, "Aa bb", "Aa", "X"), (3, "Cc dd", "Cc", "X"), (4, "Aa ee", "Aa", "Y"), (5, "Aa ff", "Aa", "Y"), (6, "Aa sp.", "Aa", "Y")],
        "rid long, species string, genus string, bin string",
    )
    d = {(1, 2): 0.0, (1, 3): 0.005, (2, 3): 0.006, (4, 5): 0.001, (4, 6): 0.0}
    pairs = spark.createDataFrame([(i, j, d.get((i, j), 0.2)) for i, j in itertools.combinations(range(1, 7), 2)], "i long, j long, d double")
    assert [(r["rid"], r["reason"], r["nn_id"]) for r in distances.suspects(pairs, rec).collect()] == [(3, "other_genus", 1)]
    r = distances.shared_barcodes(pairs, rec).collect()
    assert [(x["species_a"], x["species_b"], x["kind"], x["records"], x["shared_bin"]) for x in r] == [("Aa ee", "Aa ff", "congeneric", 2, True)]


def test_structure(spark):
    rng = np.random.default_rng(4)
    zone = [k % 2 for k in range(12)]
    d = {(i, j): float(rng.integers(1, 4)) + 3 * (zone[i] != zone[j]) for i, j in itertools.combinations(range(12), 2)}
    pairs = spark.createDataFrame([(i, j, v) for (i, j), v in d.items()], "i long, j long, d double")
    got = diversity.phi_st(pairs, spark.createDataFrame([(k, str(z)) for k, z in enumerate(zone)], "rid long, zone string"), 99).first()
    wp = sum(v for (i, j), v in d.items() if zone[i] == zone[j]) / 6
    msd = wp / 10
    sigma = ((sum(d.values()) / 12 - wp) - msd) / 6
    assert abs(got["phi_st"] - sigma / (sigma + msd)) < 1e-9 and got["p_value"] <= 0.05
    flat = {k: 1.0 for k in d}
    none = diversity.phi_st(spark.createDataFrame([(i, j, v) for (i, j), v in flat.items()], "i long, j long, d double"), spark.createDataFrame([(k, str(z)) for k, z in enumerate(zone)], "rid long, zone string"), 19).first()
    assert none["p_value"] == 1.0


def test_rarefaction_and_haplotypes(spark):
    z = spark.createDataFrame([("z", f"u{k}") for k, n in enumerate((10, 5, 2, 1, 1, 1)) for _ in range(n)], "zone string, u string")
    got = {r["m"]: r["units"] for r in diversity.rarefaction(z, "zone", "u", 8).collect()}
    assert got[5] == 2.987423 and got[10] == 4.246899 and got[20] == 6.0
    a = "".join(random.Random(5).choice("ACGT") for _ in range(90))
    b = a[:45] + ("A" if a[45] != "A" else "C") + a[46:]
    h = spark.createDataFrame([("s", x) for x in (a, a, a[5:80], b, b[:60], a[:40], a + "N")], "species string, clean string")
    r = diversity.haplotypes(h).first()
    assert (r["n"], r["haplotypes"], r["singletons"]) == (5, 2, 0) and r["hd"] == round(5 / 4 * (1 - 0.36 - 0.16), 4)


def test_identify(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("ACGT") for _ in range(400)) for _ in range(4)]
    entries = spark.createDataFrame([(k, s, f"Genus{k} sp{k}", f"Genus{k}", "Fam", f"B{k}") for k, s in enumerate(base)], "rid long, clean string, species string, genus string, family string, bin string")
    other = str.maketrans("ACGT", "CGTA")
    back = base[2][::-1].translate(str.maketrans("ACGT", "TGCA"))
    far = "".join(c.translate(other) if k % 25 == 0 else c for k, c in enumerate(base[3]))
    queries = spark.createDataFrame([(10, base[0]), (11, base[1][50:350]), (12, back), (13, far), (14, "A" * 300), (15, "")], "rid long, clean string")
    got = {r["query"]: (round(r["best"], 3), r["level"], r["taxon"]) for r in identify.identify(queries, entries, identify.kmers(entries, "rid", "clean")).collect()}
    assert got == {10: (1.0, "species", "Genus0 sp0"), 11: (1.0, "species", "Genus1 sp1"), 12: (1.0, "species", "Genus2 sp2"), 13: (0.96, "genus", "Genus3"), 14: (0.0, "none", ""), 15: (0.0, "none", "")}


def test_consensus(spark):
    hits = spark.createDataFrame([(1, 0.985, "G a", "G", "F"), (1, 0.98, "G b", "G", "F"), (2, 0.985, "G a", "G", "F"), (2, 0.976, "G a", "G", "F"), (3, 0.8, "G a", "G", "F")], "query long, identity double, species string, genus string, family string")
    assert {r["query"]: (r["level"], r["taxon"]) for r in identify.consensus(hits, hints=("family",)).collect()} == {1: ("genus", "G"), 2: ("species", "G a"), 3: ("none", "F")}


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)]
    src = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, "ts string, k string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("ts timestamp, k string, value double").parquet(src)
    root = f"file://{tmp_path}/state"
    run = lambda: feeds.run_available(spark, feeds.window_counts(stream(), "ts", "k"), "w", ["start", "k"], root)
    assert sorted((r["k"], r["n"], r["total"]) for r in run().collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    spark.createDataFrame([("2024-01-01 01:20:00", "b", 8.0)], "ts string, k string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(src)
    assert sorted((r["k"], r["n"], r["total"]) for r in run().collect()) == [("a", 2, 3.0), ("b", 2, 12.0)]  # goes on where it ended
