"""Queries over the driver's tables for the record operators, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import dictionary, ingest, reports, sequences, terms
from .operators.search import Condition as C
from .operators.search import Group, page, search, text_predicate, text_query
from .plans.materialize import once, scratch
from .plans.records import record_sql, records, table_paths

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def fold(c: str) -> str:
    return _FOLD.format(c)


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"""SELECT c_custkey, c_name, c_acctbal, c_mktsegment, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE ({fold('c_mktsegment')} = 'building' OR {fold('n_name')} LIKE '%an%') AND c_acctbal BETWEEN -500 AND 5000 AND NOT ({fold('n_name')} LIKE 'f%')
   OR c_acctbal > 9500""")
def field_search_groups(spark, sf):
    df = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "n_name")
    either = Group((C("c_mktsegment", "EQUALS", "Building"), C("n_name", "LIKE", "AN", connector="OR")))
    return search(df, [either, C("c_acctbal", "BETWEEN", 5000, -500), C("n_name", "STARTS_WITH", "F", connector="NOT"), C("c_acctbal", "GREATER_THAN", 9500, connector="OR")])


@query(f"""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY {fold('o_orderpriority')} DESC NULLS LAST, o_orderkey DESC LIMIT 50 OFFSET 100""")
def search_sorted_page(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return page(df, "o_orderpriority", "o_orderkey", 3, 50, descending=True)


@query("""SELECT p_partkey, p_brand, x AS n FROM (SELECT p_partkey, p_brand, COALESCE(TRY_CAST(regexp_extract(trim(replace(p_brand, 'Brand#', '')), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?', 0) AS DOUBLE), 0) AS x FROM part) WHERE x > 12""")
def lenient_numeric_filter(spark, sf):
    df = read(spark, sf, "part").select("p_partkey", "p_brand", T.lenient_double(F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("n"))
    return search(df, [C("n", "GREATER_THAN", 12)])


def _text_sql(where: str) -> str:
    return f"SELECT doc_id, source FROM documents WHERE {where}"


@query(_text_sql("lower(text) LIKE '%thing%' AND lower(text) LIKE '%and the%'"))
def fulltext_phrase(spark, sf):
    return read(spark, sf, "documents").where(text_predicate(["text", "lang"], text_query('thing "and the"'))).select("doc_id", "source")


@query(_text_sql("lower(text) LIKE '%der%' OR (lower(text) LIKE '%que%' AND NOT (lower(text) LIKE '%con%' AND lower(text) LIKE '%las%'))"))
def fulltext_boolean(spark, sf):
    return read(spark, sf, "documents").where(text_predicate(["text"], text_query("der OR que NOT con las"))).select("doc_id", "source")


@query(_text_sql("contains(text, 'Thing') OR contains(text, 'Der ')"))
def fulltext_case(spark, sf):
    return read(spark, sf, "documents").where(text_predicate(["text"], ("or", "Thing", "Der "), case_sensitive=True)).select("doc_id", "source")


SUGGESTED = ["p_name", "p_type", "p_brand"]
_VALUES = "WITH p AS (SELECT 0 AS k, 'p_name' AS field, p_name AS value FROM part UNION ALL SELECT 1, 'p_type', p_type FROM part UNION ALL SELECT 2, 'p_brand', p_brand FROM part)"


def _dictionary(spark, sf):
    """The dictionary of part's names, types and brands: stored once a session, opened by each query."""
    build = lambda: dictionary.store_dictionary(dictionary.value_counts(read(spark, sf, "part"), SUGGESTED), scratch(spark, "values"))
    return once(spark, "values", table_paths(sf, ("part",)), build)


@query(f"{_VALUES} SELECT k, field, value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY ALL")
def value_dictionary(spark, sf):
    return dictionary.stored_counts(spark, _dictionary(spark, sf))


@query(f"""{_VALUES},
c AS (SELECT k, field, value, count(*) AS n FROM p WHERE contains({fold('value')}, 'br') GROUP BY ALL),
f AS (SELECT value, field, n FROM c QUALIFY row_number() OVER (PARTITION BY value ORDER BY k) = 1)
SELECT value, field, n AS "rows" FROM f ORDER BY CASE WHEN starts_with({fold('value')}, 'br') THEN 0 WHEN contains(concat(' ', {fold('value')}), ' br') THEN 1 ELSE 2 END, n DESC, length(value), value LIMIT 10""")
def suggest_values(spark, sf):
    return dictionary.suggest(spark, _dictionary(spark, sf), "Br")


def _inside_sql(q: str) -> str:
    return f"""{_VALUES}, f AS (SELECT value, field, count(*) AS n FROM p WHERE contains({fold('value')}, '{q}') GROUP BY k, field, value QUALIFY row_number() OVER (PARTITION BY value ORDER BY k) = 1)
SELECT value, field, n AS "rows" FROM f ORDER BY CASE WHEN starts_with({fold('value')}, '{q}') THEN 0 WHEN contains(concat(' ', {fold('value')}), ' {q}') THEN 1 ELSE 2 END, n DESC, length(value), value LIMIT 10"""


@query(_inside_sql("idg"))
def suggest_inside_words(spark, sf):
    return dictionary.suggest(spark, _dictionary(spark, sf), "IDG")


def _pivot_sql(measure: str) -> str:
    return f"""WITH b AS (SELECT {fold("coalesce(nullif(l_returnflag, ''), '(none)')")} AS r, {fold("coalesce(nullif(n_name, ''), '(none)')")} AS c0, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
t AS (SELECT c0 FROM b GROUP BY c0 ORDER BY count(*) DESC, c0 LIMIT 15),
f AS (SELECT r, CASE WHEN c0 IN (SELECT c0 FROM t) THEN c0 ELSE 'Other' END AS c, l_partkey FROM b)
SELECT r AS row_label, c AS col_label, grouping(c) = 1 AS is_row_total, grouping(r) = 1 AS is_col_total, {measure} AS value FROM f GROUP BY CUBE (r, c)"""


def _pivot(spark, sf, measure):
    li, su, na = (read(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    df = li.join(su, F.col("s_suppkey") == F.col("l_suppkey")).join(na, F.col("n_nationkey") == F.col("s_nationkey")).select("l_returnflag", "n_name", "l_partkey")
    return reports.pivot_cells(df, "l_returnflag", "n_name", measure)


@query(_pivot_sql("count(*)"))
def pivot_records(spark, sf):
    return _pivot(spark, sf, F.count("*"))


@query(_pivot_sql("count(DISTINCT l_partkey)"))
def pivot_distinct(spark, sf):
    return _pivot(spark, sf, F.count_distinct("l_partkey"))


_REC = f"WITH rec AS ({record_sql()})"
TERMS = ["Genusa epithete", "genusb", "FAMILY1", "Nosuch name"]
_TERMS = ", ".join(f"('{t}')" for t in TERMS)
_MATCH = f"""{_REC}, t(term) AS (VALUES {_TERMS}), m AS (
SELECT rid, term, bin_uri FROM rec JOIN t ON {fold('term')} = {fold('species')} UNION ALL SELECT rid, term, bin_uri FROM rec JOIN t ON {fold('term')} = {fold('genus')} UNION ALL SELECT rid, term, bin_uri FROM rec JOIN t ON {fold('term')} = {fold('family')})"""


def _matches(spark, sf):
    rec = records(spark, sf)
    return rec, terms.match_taxa(rec, spark.createDataFrame([(t, t) for t in TERMS], "term string, value string"), "rid", "species", ["genus", "family"])


@query(f"{_MATCH} SELECT term, count(DISTINCT rid) AS records FROM m GROUP BY term")
def batch_taxonomy_levels(spark, sf):
    return reports.term_counts(_matches(spark, sf)[1], "rid")


@query(f"{_MATCH} SELECT term FROM t WHERE term NOT IN (SELECT term FROM m)")
def batch_not_found(spark, sf):
    return spark.createDataFrame([(t,) for t in TERMS], "term string").join(_matches(spark, sf)[1], "term", "left_anti")


@query(f"{_MATCH} SELECT bin_uri AS value, count(DISTINCT rid) AS n FROM m WHERE bin_uri IS NOT NULL GROUP BY bin_uri")
def batch_breakdown(spark, sf):
    rec, m = _matches(spark, sf)
    return rec.join(m, "rid").where("bin_uri is not null").groupBy(F.col("bin_uri").alias("value")).agg(F.count_distinct("rid").alias("n"))


@query(f"""{_REC}, c AS (SELECT genus AS key, {fold('country')} AS k, count(*) AS n, min(country) AS label FROM rec WHERE country <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, label) AS g FROM c)
SELECT key, count(*) AS n_values, string_agg(label || ' (' || n || ')', '; ' ORDER BY g) FILTER (WHERE g <= 3) AS top_values FROM r GROUP BY key""")
def batch_metrics_list(spark, sf):
    return reports.value_lists(records(spark, sf), "genus", "country")


def _table_sql(full: bool) -> str:
    cut = "" if full else "ORDER BY row_total DESC, r LIMIT 300"
    other = "c0" if full else "CASE WHEN c0 IN (SELECT c0 FROM t) THEN c0 ELSE 'Other' END"
    return f"""WITH b AS (SELECT CAST(l_partkey AS VARCHAR) AS r, {fold("coalesce(nullif(c_name, ''), '(none)')")} AS c0 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
t AS (SELECT c0 FROM b GROUP BY c0 ORDER BY count(*) DESC, c0 LIMIT 15), f AS (SELECT r, {other} AS c FROM b), rt AS (SELECT r, count(*) AS row_total FROM f GROUP BY r {cut}), ct AS (SELECT c, count(*) AS col_total FROM f GROUP BY c)
SELECT r AS row_label, row_total, c AS col_label, col_total, count(*) AS "value" FROM f JOIN rt USING (r) JOIN ct USING (c) GROUP BY ALL"""


def _table(spark, sf, full):
    li, o, c = (read(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    df = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    return reports.pivot_table(df.select(F.col("l_partkey").cast("string").alias("l_partkey"), "c_name"), "l_partkey", "c_name", F.count("*"), full)


@query(_table_sql(False))
def pivot_table(spark, sf):
    return _table(spark, sf, False)


@query(_table_sql(True))
def pivot_table_full(spark, sf):
    return _table(spark, sf, True)


_DIFF = """WITH o AS (SELECT l_orderkey, l_linenumber, md5(concat(l_partkey, '|', l_suppkey, '|', l_quantity::INT)) AS h, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id FROM lineitem),
a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, h ORDER BY id) AS k FROM o WHERE id % 17 <> 0),
b0 AS (SELECT l_orderkey, l_linenumber, CASE WHEN id % 23 = 0 THEN 'changed' ELSE h END AS h, id FROM o WHERE id % 19 <> 0),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, h ORDER BY id) AS k FROM b0),
x AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS p, coalesce(a.l_linenumber, b.l_linenumber) AS q, a.id AS old_id, b.id AS new_id FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.h = b.h AND a.k = b.k),
l AS (SELECT p, q, old_id, row_number() OVER (PARTITION BY p, q ORDER BY old_id) AS j FROM x WHERE new_id IS NULL),
r AS (SELECT p, q, new_id, row_number() OVER (PARTITION BY p, q ORDER BY new_id) AS j FROM x WHERE old_id IS NULL),
d AS (SELECT 'same' AS op, old_id, new_id FROM x WHERE old_id IS NOT NULL AND new_id IS NOT NULL UNION ALL
SELECT CASE WHEN old_id IS NULL THEN 'new' WHEN new_id IS NULL THEN 'gone' ELSE 'chg' END, old_id, new_id FROM l FULL JOIN r USING (p, q, j)) """


#: Lines that agree in these are alike in all that the snapshots hold, so that any order among them gives the same rows.
_LINE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
#: A line's hash, from what a snapshot holds of it.
LINE_HASH = "case when changed then 'changed' else md5(concat(l_partkey, '|', l_suppkey, '|', cast(l_quantity as int))) end"


def _versions(spark, sf):
    o = ingest.numbered(read(spark, sf, "lineitem").select(*_LINE_ORDER), _LINE_ORDER, "id").withColumn("changed", F.lit(False))
    new = o.where("id % 19 <> 0").withColumn("changed", F.expr("id % 23 = 0"))
    return tuple(v.withColumn("h", F.expr(LINE_HASH)) for v in (o.where("id % 17 <> 0"), new))


def _diff(spark, sf):
    return reports.snapshot_diff(*_versions(spark, sf), ["l_orderkey", "l_linenumber"], "id", "id")


@query(_DIFF + "SELECT op, old_id, new_id FROM d")
def snapshot_diff(spark, sf):
    return _diff(spark, sf)


@query(_DIFF + "SELECT count(old_id) AS n_old, count(*) FILTER (WHERE op <> 'same') AS changed, count(*) FILTER (WHERE op <> 'same') > 0.10 * greatest(count(old_id), 1) AS refused FROM d")
def change_rate_guard(spark, sf):
    return reports.change_rate(_diff(spark, sf))


@query(f"{_REC} SELECT rid, concat(processid, '|', coalesce(bin_uri, ''), '|', replace(coalesce(nullif(trim(species), ''), nullif(trim(genus), ''), family), ' ', '_'), '|', marker_code) AS header, length(regexp_replace(nuc, '^N+|N+$', '', 'g')) AS bases FROM rec WHERE length(regexp_replace(nuc, '^N+|N+$', '', 'g')) >= 50")
def best_taxon_fasta(spark, sf):
    seq = T.clean_sequence(F.col("nuc"))
    taxon = T.best_taxon(F.col("species"), F.col("genus"), F.col("family"))
    header = F.concat("processid", F.lit("|"), F.coalesce("bin_uri", F.lit("")), F.lit("|"), taxon, F.lit("|"), "marker_code")
    return records(spark, sf).select("rid", header.alias("header"), F.length(seq).alias("bases")).where("bases >= 50")


def _stops_sql(f: int) -> str:
    return f"len(list_filter(range(0, greatest((len - {f}) // 3 - 1, 0)), lambda i: substr(s, i * 3 + {f + 1}, 3) IN ('TAA', 'TAG')))"


@query(f"""{_REC}, s AS (SELECT rid, regexp_replace(nuc, '^N+|N+$', '', 'g') AS s FROM rec), n AS (SELECT rid, s, length(s) AS len,
length(s) - length(replace(s, 'A', '')) AS a, length(s) - length(replace(s, 'C', '')) AS c, length(s) - length(replace(s, 'G', '')) AS g, length(s) - length(replace(s, 'T', '')) AS t FROM s),
k AS (SELECT *, {_stops_sql(0)} AS s0, {_stops_sql(1)} AS s1, {_stops_sql(2)} AS s2 FROM n)
SELECT rid, len AS length, a, c, g, t, round(100.0 * (g + c) / greatest(a + c + g + t, 1), 2)::DOUBLE AS gc_pct, len - a - c - g - t AS ambiguous,
CASE WHEN s0 = least(s0, s1, s2) THEN 0 WHEN s1 = least(s0, s1, s2) THEN 1 ELSE 2 END AS frame, least(s0, s1, s2) AS stops FROM k WHERE len >= 50""")
def composition_flags(spark, sf):
    return sequences.composition(records(spark, sf).select("rid", "nuc"), "nuc", texts=False).select("rid", "length", "a", "c", "g", "t", "gc_pct", "ambiguous", "frame", "stops")


@query(f"{_REC} SELECT {fold('marker_code')} AS marker, count(*) AS n, count(DISTINCT species) AS species, count(DISTINCT bin_uri) AS bins FROM rec GROUP BY ALL")
def marker_counts(spark, sf):
    return records(spark, sf).groupBy(T.fold(F.col("marker_code")).alias("marker")).agg(F.count("*").alias("n"), F.count_distinct("species").alias("species"), F.count_distinct("bin_uri").alias("bins"))


@query(f"{_REC} SELECT bin_uri, count(*) AS n, count(DISTINCT species) AS species, count(DISTINCT country) AS countries, count(DISTINCT species) > 1 AS shared FROM rec WHERE bin_uri IS NOT NULL GROUP BY bin_uri")
def concordance_bins(spark, sf):
    g = records(spark, sf).where("bin_uri is not null").groupBy("bin_uri")
    return g.agg(F.count("*").alias("n"), F.count_distinct("species").alias("species"), F.count_distinct("country").alias("countries")).withColumn("shared", F.col("species") > 1)


@query(f"""WITH z AS ({record_sql()}), c AS (SELECT country AS zone, species, count(*) AS c FROM z WHERE species IS NOT NULL GROUP BY ALL),
s AS (SELECT zone, sum(c)::BIGINT AS n, count(*) AS s, count(*) FILTER (WHERE c = 1) AS f1, count(*) FILTER (WHERE c = 2) AS f2 FROM c GROUP BY zone)
SELECT zone, n, s, f1, f2, round(s + (n - 1)::DOUBLE / n * f1 * (f1 - 1) / (2 * (f2 + 1)), 6) AS chao1,
round(CASE WHEN f2 > 0 THEN 1 - f1::DOUBLE / n * ((n - 1)::DOUBLE * f1 / ((n - 1)::DOUBLE * f1 + 2 * f2)) WHEN f1 > 0 THEN 1 - f1::DOUBLE / n * ((n - 1)::DOUBLE * (f1 - 1) / nullif((n - 1)::DOUBLE * (f1 - 1) + 2, 0)) ELSE 1 END, 6) AS coverage FROM s""")
def zone_richness(spark, sf):
    return sequences.chao1(records(spark, sf), "country", "species")


@query(f"""WITH z AS ({record_sql()}), o AS (SELECT DISTINCT country AS zone, species AS u FROM z WHERE species IS NOT NULL), s AS (SELECT zone, count(*) AS s FROM o GROUP BY zone),
h AS (SELECT l.zone AS zone1, r.zone AS zone2, count(*) AS a FROM o l JOIN o r ON l.u = r.u AND l.zone < r.zone GROUP BY ALL),
x AS (SELECT zone1, zone2, a, s1.s - a AS b, s2.s - a AS c FROM h JOIN s s1 ON s1.zone = zone1 JOIN s s2 ON s2.zone = zone2)
SELECT zone1, zone2, a, b, c, round((b + c)::DOUBLE / (2 * a + b + c), 6) AS sorensen, round(least(b, c)::DOUBLE / (a + least(b, c)), 6) AS simpson,
round((b + c)::DOUBLE / (2 * a + b + c) - least(b, c)::DOUBLE / (a + least(b, c)), 6) AS nestedness FROM x""")
def beta_pairs(spark, sf):
    return sequences.beta_pairs(records(spark, sf), "country", "species")
