"""Queries of sequence quality, term lists, lookups and agreement over the record view, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import alignment, distances, lookups, quality, sequences, shape, terms
from .plans.materialize import materialize, once
from .plans.records import record_sql, records, specimens, table_paths
from .queries import fold, query

_REC = f"WITH rec AS ({record_sql()})"
#: Of what the records lack, as texts for both engines: higher ranks, other markers, sequences from the other strand.
_RANKS = """CASE WHEN rid % 25 = 0 THEN 'Ascidiacea' END AS class, CASE rid % 5 WHEN 0 THEN 'Chordata' WHEN 1 THEN 'Echinodermata' WHEN 2 THEN 'Arthropoda' END AS phylum,
CASE WHEN rid % 7 = 3 THEN 'Fungi' WHEN rid % 11 = 4 THEN 'Plantae' ELSE 'Animalia' END AS kingdom, CASE WHEN rid % 17 = 0 THEN 'rbcL' WHEN rid % 19 = 0 THEN '' ELSE marker_code END AS marker"""
_SEQ = """CASE WHEN rid % 23 = 0 THEN reverse(translate(nuc, 'ACGTRY', 'TGCAYR')) WHEN rid % 41 = 0 THEN concat(substr(nuc, 1, 50), '*', substr(nuc, 52)) WHEN rid % 43 = 0 THEN substr(nuc, 1, 45) ELSE nuc END AS seq"""


def _frame(s: str, f: int) -> str:
    return f"len(list_filter(range(0, greatest((length({s}) - {f}) // 3 - 1, 0)), lambda i: list_contains(st, substr({s}, i * 3 + {f + 1}, 3))))"


_COMPOSED = f"""{_REC}, r AS (SELECT rid, {_RANKS}, {_SEQ} FROM rec), s0 AS (SELECT *, regexp_replace(seq, '^N+|N+$', '', 'g') AS s FROM r),
s1 AS (SELECT *, CASE WHEN upper(marker) = 'RBCL' THEN 11 WHEN upper(marker) <> 'COI-5P' THEN NULL WHEN class = 'Ascidiacea' THEN 13 WHEN phylum = 'Chordata' THEN 2 WHEN phylum = 'Echinodermata' THEN 9 WHEN kingdom = 'Fungi' THEN 4 WHEN kingdom = 'Plantae' THEN 1 ELSE 5 END AS code FROM s0 WHERE length(s) >= 50),
s2 AS (SELECT *, CASE WHEN code IN (1, 11) THEN ['TAA', 'TAG', 'TGA'] WHEN code = 2 THEN ['TAA', 'TAG', 'AGA', 'AGG'] ELSE ['TAA', 'TAG'] END AS st, reverse(translate(s, 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')) AS rc FROM s1),
s3 AS (SELECT *, CASE WHEN code IS NOT NULL THEN [{_frame('s', 0)}, {_frame('s', 1)}, {_frame('s', 2)}] END AS f FROM s2),
s4 AS (SELECT *, CASE WHEN list_min(f) > 0 THEN [{_frame('rc', 0)}, {_frame('rc', 1)}, {_frame('rc', 2)}] END AS b FROM s3),
s5 AS (SELECT *, coalesce(list_min(b) = 0, false) AS rv FROM s4),
s6 AS (SELECT *, CASE WHEN rv THEN rc ELSE s END AS rd, CASE WHEN rv THEN -list_position(b, 0) ELSE list_position(f, list_min(f)) END AS frame, CASE WHEN rv THEN 0 ELSE list_min(f) END AS stops,
  length(s) - length(replace(s, 'A', '')) AS a, length(s) - length(replace(s, 'C', '')) AS c, length(s) - length(replace(s, 'G', '')) AS g, length(s) - length(replace(s, 'T', '')) AS t, length(s) - length(replace(s, 'N', '')) AS n,
  length(s) - length(regexp_replace(s, '[RYKMSWBDHV]', '', 'g')) AS ambiguous FROM s5),
s7 AS (SELECT *, length(s) - a - c - g - t - n - ambiguous AS invalid, n::DOUBLE / length(s) > 0.01 AS many, upper(marker) IN ('', 'COI-5P') AS applies,
  list_filter(list_transform(range(abs(frame) + 1, length(rd), 3), lambda i: substr(rd, i + 1, 1)), lambda x: x IN ('A', 'C', 'G', 'T')) AS third FROM s6),
rows AS (SELECT rid, length(s) AS length, a, c, g, t, n, ambiguous, invalid, round(100.0 * (g + c) / nullif(a + c + g + t, 0), 2)::DOUBLE AS gc, code, frame, stops, rv AS reversed,
  CASE WHEN frame IS NOT NULL THEN round(100.0 * len(list_filter(third, lambda x: x IN ('G', 'C'))) / nullif(len(third), 0), 2)::DOUBLE END AS gc3,
  CASE WHEN applies THEN length(s) >= 500 AND NOT many AND invalid = 0 AND coalesce(stops, 0) = 0 AND NOT rv END AS barcode,
  concat_ws(',', CASE WHEN ambiguous > 0 THEN 'ambiguous' END, CASE WHEN invalid > 0 THEN 'invalid' END, CASE WHEN many THEN 'many_n' END, CASE WHEN rv THEN 'reversed' END,
    CASE WHEN applies AND length(s) < 500 THEN 'short' END, CASE WHEN coalesce(stops, 0) > 0 AND NOT rv THEN 'stops' END) AS flags FROM s7) """


def _composed(spark, sf):
    """Composition and translation of all records, made once a session for all queries that want some of it."""

    def build():
        records(spark, sf).createOrReplaceTempView("_rv_rec")
        own = spark.sql(f"SELECT rid, {_RANKS}, {_SEQ} FROM _rv_rec")
        return materialize(quality.composition_rows(own, "seq", "marker", texts=False), "composition")

    return once(spark, "composition", table_paths(sf), build)


_SHOWN = ["rid", "length", "a", "c", "g", "t", "n", "ambiguous", "invalid", "gc", "code", "frame", "stops", "reversed", "gc3", "barcode"]


@query(f"{_COMPOSED} SELECT {', '.join(_SHOWN)}, flags FROM rows")
def composition_translated(spark, sf):
    return _composed(spark, sf).select(*_SHOWN, F.array_join("flags", ",").alias("flags"))


@query(f"""{_COMPOSED}, l AS (SELECT 'length' AS what, length::DOUBLE AS x FROM rows UNION ALL SELECT 'gc', gc FROM rows UNION ALL SELECT 'gc3', gc3 FROM rows),
m AS (SELECT what, min(x) AS least, max(x) AS most, avg(x) AS mean, median(x) AS median FROM l GROUP BY what)
SELECT what, {', '.join(f"CASE WHEN what = 'length' THEN round({c}, 0) ELSE round({c}, 1) END AS {c}" for c in ("least", "most", "mean", "median"))} FROM m""")
def composition_summary(spark, sf):
    return quality.summary(_composed(spark, sf))


@query(f"{_COMPOSED} SELECT unnest(string_split(flags, ',')) AS flag, count(*) AS n FROM rows WHERE flags <> '' GROUP BY flag")
def composition_flag_counts(spark, sf):
    return quality.flag_counts(_composed(spark, sf))


@query(f"{_COMPOSED} SELECT count(*) AS analysed, count(stops) AS translated, count(*) FILTER (WHERE stops > 0) AS with_stops, count(barcode) AS barcode_applicable, count(*) FILTER (WHERE barcode) AS barcode_compliant FROM rows")
def barcode_verdicts(spark, sf):
    return quality.verdicts(_composed(spark, sf))


@query(f"{_COMPOSED} SELECT CASE WHEN length < 100 THEN 'short' ELSE 'stops' END AS reason, count(*) AS n FROM rows WHERE length < 100 OR contains(flags, 'stops') OR contains(flags, 'invalid') GROUP BY reason")
def unusable_sequences(spark, sf):
    return quality.left_out(_composed(spark, sf))


@query()
def better_genetic_code(spark, sf):
    return quality.better_code(_composed(spark, sf))


PASTED = ["genusa_epithete", "GENUSB", "genusb", "Fámily1", "Nosuch name", " ", "genusa"]
_PAIRS = "('Genusa epithete', 'Genusa epithete'), ('Genusb', 'Genusb'), ('Family1', 'Family1'), ('Family1', 'Fámily1'), ('Nosuch name', 'Nosuch name'), ('Genusa', 'Genusa')"
_TAXA = f"""{_REC}, t(term, value) AS (VALUES {_PAIRS}), m AS (SELECT DISTINCT rid, term FROM rec JOIN t ON {fold('value')} = {fold('species')} OR (NOT contains(value, ' ') AND ({fold('value')} = {fold('genus')} OR {fold('value')} = {fold('family')})))"""


def _taxa(spark, sf):
    rec, own = records(spark, sf), terms.term_table(spark, PASTED, taxonomy=True)
    return rec, own, terms.match_taxa(rec, own, "rid", "species", ["genus", "family"])


@query(f"{_TAXA} SELECT term, count(*) AS records FROM m GROUP BY term")
def term_matches(spark, sf):
    return _taxa(spark, sf)[2].groupBy("term").agg(F.count("*").alias("records"))


@query(f"""{_TAXA}, v AS (SELECT rid, 'country' AS "column", country AS value FROM rec UNION ALL SELECT rid, 'bin_uri', bin_uri FROM rec),
c AS (SELECT term, "column", value, count(*) AS n FROM m JOIN v USING (rid) WHERE value <> '' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY term, "column" ORDER BY n DESC, value) AS k FROM c)
SELECT term, "column", count(*) AS n_values, string_agg(concat(value, ' (', format('{{:,}}', n), ')'), '; ' ORDER BY k) FILTER (WHERE k <= 3) || CASE WHEN count(*) > 3 THEN concat('; and ', format('{{:,}}', count(*) - 3), ' more') ELSE '' END AS listed FROM k GROUP BY term, "column" """)
def term_metrics(spark, sf):
    rec, _, m = _taxa(spark, sf)
    return terms.metric_lists(rec, m, "rid", ["country", "bin_uri"], most=3)


PLACES = ["nation_3", "NATION_7", "nowhere"]


@query(f"""{_TAXA}, p(value2) AS (VALUES {', '.join(f"('{p}')" for p in PLACES)}), f AS (SELECT value2, term, count(DISTINCT m.rid) AS n FROM m JOIN rec USING (rid) JOIN p ON {fold('value2')} = {fold('country')} GROUP BY ALL)
SELECT value2, coalesce(sum(n), 0)::BIGINT AS records, count(term) AS found, (SELECT count(DISTINCT term) FROM t) - count(term) AS not_found FROM p LEFT JOIN f USING (value2) GROUP BY value2""")
def second_field_summary(spark, sf):
    rec, own, m = _taxa(spark, sf)
    places = spark.createDataFrame([(p,) for p in PLACES], "value2 string")
    found = m.join(rec.select("rid", T.fold(F.col("country")).alias("k")), "rid").join(places.withColumn("k", T.fold(F.col("value2"))), "k").select("rid", "term", "value2")
    return terms.second_field_summary(own, PLACES, found, "rid")


@query(f"""{_REC}, r AS (SELECT coalesce(species, '') AS name, CASE WHEN species NOT LIKE '% sp.' THEN species END AS s, coalesce(bin_uri, '') AS b FROM rec), e AS (SELECT DISTINCT s, b FROM r WHERE s IS NOT NULL AND b <> ''),
k AS (SELECT b, count(*) AS k FROM e GROUP BY b), p AS (SELECT s, count(*) AS n, max(k) AS k FROM e JOIN k USING (b) GROUP BY s)
SELECT (SELECT count(*) FROM p) AS species, (SELECT count(DISTINCT b) FROM r WHERE name <> '' AND b <> '') AS bins, (SELECT count(*) FROM r WHERE name <> '' AND b <> '') AS paired_records, (SELECT count(*) FROM r WHERE name <> '' AND b = '') AS species_only,
(SELECT count(*) FROM r WHERE name = '' AND b <> '') AS bin_only, (SELECT count(*) FROM p WHERE n = 1 AND k = 1) AS concordant_species, (SELECT count(*) FROM k WHERE k > 1) AS shared_bins, (SELECT count(*) FROM p WHERE n > 1) AS split_species""")
def concordance_sides(spark, sf):
    return lookups.concordance(records(spark, sf), "species", "bin_uri")


_WANTED = ["BIN:1", "BIN:6", "BIN:99"]


@query(f"""{_REC}, c AS (SELECT bin_uri AS bin, species AS name, count(*) AS n FROM rec WHERE species <> '' AND bin_uri IN ({', '.join(f"'{b}'" for b in _WANTED)}) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY n DESC, name) AS k FROM c)
SELECT bin, sum(n)::BIGINT AS total, string_agg(concat(name, ':', n), ',' ORDER BY k) FILTER (WHERE k <= 5) AS species FROM k GROUP BY bin""")
def bin_species_lookup(spark, sf):
    wanted = spark.createDataFrame([(b,) for b in _WANTED], "bin string")
    found = lookups.bin_species(records(spark, sf), wanted, "bin_uri", "species")
    return found.select("bin", "total", F.array_join(F.transform("species", lambda x: F.concat_ws(":", x["name"], x["n"].cast("string"))), ",").alias("species"))


_NAMES = ["Genusa", "Family1", "Genusz", "Genusb epithetb"]


@query(f"""{_REC}, n AS (SELECT unnest([{', '.join(f"'{x}'" for x in _NAMES)}]) AS name), x AS (SELECT name, CASE WHEN name IN (SELECT species FROM rec) THEN 'species' WHEN name IN (SELECT genus FROM rec) THEN 'genus' WHEN name IN (SELECT family FROM rec) THEN 'family' END AS rank FROM n),
g AS (SELECT name, rank, rec.* FROM x JOIN rec ON name = CASE rank WHEN 'species' THEN species WHEN 'genus' THEN genus WHEN 'family' THEN family END)
SELECT name, rank, CASE WHEN rank = 'species' THEN name END AS species, CASE WHEN rank = 'genus' THEN name WHEN rank = 'species' THEN mode(genus) END AS genus, CASE WHEN rank = 'family' THEN name ELSE mode(family) END AS family FROM g GROUP BY name, rank""")
def name_lineages(spark, sf):
    return lookups.lineages(records(spark, sf), spark.createDataFrame([(n,) for n in _NAMES], "name string"), ["species", "genus", "family"], "family")


@query()
def joined_haplotypes(spark, sf):
    clean = specimens(spark, sf).where("species is not null").select("species", T.clean_sequence(F.col("nuc")).alias("clean")).where("not clean rlike '[^ACGT]'")
    return lookups.joined_haplotypes(clean)


@query(f"{_REC} SELECT 'country' AS \"column\", count(DISTINCT nullif(country, '')) AS n_values FROM rec UNION ALL SELECT 'species', count(DISTINCT nullif(species, '')) FROM rec UNION ALL SELECT 'bin_uri', count(DISTINCT bin_uri) FROM rec")
def category_counts(spark, sf):
    return shape.category_counts(records(spark, sf), ["country", "species", "bin_uri"])


@query(f"""{_REC}, v AS (SELECT 'country' AS "column", country AS v FROM rec UNION ALL SELECT 'species', species FROM rec UNION ALL SELECT 'processid', processid FROM rec), c AS (SELECT "column", v, count(*) AS n FROM v WHERE v <> '' GROUP BY ALL)
SELECT "column", sum(n)::BIGINT AS filled, count(*) AS groups, count(*) FILTER (WHERE n >= 20) AS big_groups FROM c GROUP BY "column" """)
def group_sizes(spark, sf):
    return shape.group_sizes(records(spark, sf), ["country", "species", "processid"])


@query(f"{_REC} SELECT rid, processid FROM rec WHERE {fold('marker_code')} = 'coi-5p' AND nuc <> '' AND (contains(lower(country), 'tst11') OR starts_with(processid, 'TST11'))")
def text_or_id_prefix(spark, sf):
    own = shape.of_marker(records(spark, sf), "marker_code", "coi-5P", "nuc")
    return own.where(shape.text_or_id(F.contains(F.lower("country"), F.lit("tst11")), "TST11", "processid")).select("rid", "processid")


@query()
def aligned_distances(spark, sf):
    """The whole chain: composition, what is fit, groups by reference, and distances on the aligned columns."""
    raw = specimens(spark, sf).select("rid", F.col("marker_code").alias("marker"), F.replace("nuc", F.lit("-"), F.lit("")).alias("seq"), *[F.lit(None).cast("string").alias(c) for c in ("class", "phylum", "kingdom")])
    fit = quality.usable(materialize(quality.composition_rows(raw, "seq", "marker"), "composition"))
    groups = materialize(alignment.align_groups(fit, "rid", "read").where("group is not null"), "aligned")
    # Records with one row are a class: what is said of two classes holds for all pairs of their members.
    classes, members = distances.alike(groups.select("rid", "group", "row"), ["group", "row"])
    counts = materialize(sequences.pair_counts(classes, "group", "rid", "row"), "pairs")
    pairs = distances.class_pairs(counts, classes, "group", "row").where("sites >= 100")
    told = pairs.select("group", "i", "j", "sites", F.round(sequences.distance("p"), 6).alias("d_p"), F.round(sequences.distance("k2p"), 6).alias("d_k2p"))
    return distances.pairs_of_members(materialize(told, "class_pairs"), materialize(members, "members"))


@query(f"""{_REC}, c AS (SELECT country AS zone, processid, count(*) AS c FROM rec GROUP BY ALL),
s AS (SELECT zone, sum(c)::DOUBLE AS n, count(*) AS s, count(*) FILTER (WHERE c = 1)::DOUBLE AS f1, count(*) FILTER (WHERE c = 2)::DOUBLE AS f2 FROM c GROUP BY zone),
e AS (SELECT *, (n - 1) / n AS k, s + (n - 1) / n * f1 * (f1 - 1) / (2 * (f2 + 1)) AS est FROM s),
v AS (SELECT *, est - s AS t, CASE WHEN f2 > 0 THEN k * f1 * (f1 - 1) / (2 * (f2 + 1)) + k * k * f1 * pow(2 * f1 - 1, 2) / (4 * pow(f2 + 1, 2)) + k * k * f1 * f1 * f2 * pow(f1 - 1, 2) / (4 * pow(f2 + 1, 4))
ELSE k * f1 * (f1 - 1) / 2 + k * k * f1 * pow(2 * f1 - 1, 2) / 4 - k * k * pow(f1, 4) / (4 * est) END AS var FROM e),
x AS (SELECT *, CASE WHEN t > 0 AND var > 0 THEN exp(1.96 * sqrt(ln(1 + var / (t * t)))) END AS c FROM v)
SELECT zone, s, round(est, 6) AS chao1, round(CASE WHEN c IS NOT NULL THEN s + t / c ELSE s END, 6)::DOUBLE AS low, round(CASE WHEN c IS NOT NULL THEN s + t * c ELSE est END, 6)::DOUBLE AS high FROM x""")
def zone_richness_interval(spark, sf):
    """Of specimens: each species of this view is seen more than twice in each zone."""
    return sequences.chao1_interval(records(spark, sf), "country", "processid")


@query("""WITH n AS (SELECT length(text) AS len FROM documents WHERE text IS NOT NULL), e AS (SELECT min(len) // 25 * 25 AS lo, max(len) // 25 * 25 AS hi FROM n), w AS (SELECT *, (25 * pow(2, greatest(0, ceil(log2((hi - lo) / (25.0::DOUBLE * 60))))))::BIGINT AS w FROM e),
g AS (SELECT lo // w * w AS lo, hi, w FROM w), c AS (SELECT (len - lo) // w * w + lo AS f, count(*) AS n FROM n, g GROUP BY f)
SELECT x.f AS "from", x.f + g.w - 1 AS "to", coalesce(c.n, 0) AS n FROM (SELECT unnest(range(lo, hi + 1, w)) AS f FROM g) x CROSS JOIN g LEFT JOIN c ON c.f = x.f""")
def length_bars(spark, sf):
    return sequences.length_bars(spark.read.parquet(f"{sf}/documents.parquet"), "text")
