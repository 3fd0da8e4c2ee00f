"""Record-shaped views of the driver's tables: barcode sequences grown from part, supplier, nation and region.

`records` has a row per line item, with raw sequences; `specimens` a row per supplier, with aligned ones: pair reports
ask for all pairs, which a table of that size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import numbered
from .materialize import materialize, once

ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_NUMBER = f"CAST(ROW_NUMBER() OVER (ORDER BY {', '.join(ORDER)}) AS BIGINT) AS rid"


def _bases(key: str, alphabet: str) -> str:
    return f"translate(md5({key}), '0123456789abcdef', {alphabet})"


_LINES = "l_partkey AS pk, l_suppkey AS sk, l_returnflag AS rf FROM lineitem"
_RAW = """CASE WHEN rid % 97 = 0 THEN concat(substr(m, 1, 30), 'TAATTAATTAA', substr(m, 42))
           WHEN rid % 7 = 0 THEN substr(m, 1, 600) WHEN rid % 11 = 0 THEN substr(m, 21)
           WHEN rid % 31 = 0 THEN concat('NNN', substr(m, 1, 200), 'NRY', substr(m, 204)) ELSE m END"""
_ALIGNED = """CASE WHEN rid % 7 = 0 THEN substr(m, 1, 600) WHEN rid % 11 = 0 THEN concat(repeat('-', 20), substr(m, 21))
           WHEN rid % 31 = 0 THEN concat(substr(m, 1, 100), 'NRY', substr(m, 104)) ELSE m END"""


#: How the raw sequences lie over a whole one: what an alignment of them should give.
_TRUE = """CASE WHEN rid % 97 = 0 THEN concat(substr(m, 1, 30), 'TAATTAATTAA', substr(m, 42)) WHEN rid % 7 = 0 THEN concat(substr(m, 1, 600), repeat('-', 40))
           WHEN rid % 11 = 0 THEN concat(repeat('-', 20), substr(m, 21)) WHEN rid % 31 = 0 THEN concat(substr(m, 1, 200), 'NRY', substr(m, 204)) ELSE m END"""


def true_alignment_sql() -> str:
    """The records with the true alignment of their raw sequences."""
    return record_sql(nuc=_TRUE)


def specimen_sql() -> str:
    return record_sql("true", *_SUPPLIERS, _ALIGNED, _MISTAKEN)


def _alphabet() -> str:
    return "CASE WHEN marker_code = '16S' THEN 'ACGTACGTACGTACGT' ELSE 'ACGACGACGACGACGA' END"


def _whole() -> str:
    """A whole sequence, before its record's own changes: it hangs on spk, pk % 4 and marker_code alone."""
    al = _alphabet()
    part = lambda pre, key, n: ", ".join(_bases(f"concat('{pre}', CAST({key} AS VARCHAR(20)), '{c}')", al) for c in n)
    common = ", ".join(_bases(f"'x{i}'", al) for i in range(10))
    return f"concat({part('s', 'CASE WHEN spk = 10 THEN 6 ELSE spk END', 'abcd')}, {part('g', 'pk % 4', 'abcdef')}, {common})"


_MARKER = "CASE WHEN p_size % 5 = 0 THEN '16S' ELSE 'COI-5P' END"
_MUTATED = "concat(substr(c0, 1, CAST((rid % 40) * 16 AS INT)), substr('ACG', CAST(rid % 3 + 1 AS INT), 1), substr(c0, CAST((rid % 40) * 16 + 2 AS INT)))"


def _columns(nuc: str, misnamed: str) -> str:
    return f"""SELECT rid, concat('TST', CAST(pk AS VARCHAR(20)), '-', CAST(sk % 30 AS VARCHAR(20))) AS processid, marker_code,
      CASE WHEN rf = 'R' THEN NULL ELSE concat('BIN:', CAST(spk AS VARCHAR(20))) END AS bin_uri,
      concat('Family', CAST(pk % 2 AS VARCHAR(20))) AS family, concat('Genus', chr(CAST(97 + pk % 4 AS INT))) AS genus,
      CASE WHEN rid % 13 = 0 THEN NULL {misnamed} WHEN spk = 11 THEN concat('Genus', chr(CAST(97 + pk % 4 AS INT)), ' sp.')
           ELSE concat('Genus', chr(CAST(97 + pk % 4 AS INT)), ' epithet', chr(CAST(97 + spk AS INT))) END AS species,
      n_name AS country, r_name AS region, concat('[', CAST(n_nationkey * 3 - 40 AS VARCHAR(20)), '.5, ', CAST(n_nationkey * 7 - 90 AS VARCHAR(20)), '.25]') AS coord,
      {nuc} AS nuc
    FROM mut"""


def _thin(rid: str, base: str, where: str = "true") -> str:
    return f"""base AS (
      SELECT {rid}, {base}),
    j AS (
      SELECT rid, pk, sk, rf, pk % 12 AS spk, {_MARKER} AS marker_code, n_nationkey, n_name, r_name
      FROM base JOIN part ON p_partkey = pk JOIN supplier ON s_suppkey = sk JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
      WHERE {where})"""


def record_sql(where: str = "true", rid: str = _NUMBER, base: str = _LINES, nuc: str = _RAW, misnamed: str = "") -> str:
    """One text for Spark and DuckDB. Row ids follow a total order of lineitem's columns; `rid` names a column that has
    them already."""
    return f"""
    WITH {_thin(rid, base, where)},
    cons AS (
      SELECT *, {_whole()} AS c0 FROM j),
    mut AS (
      SELECT *, {_MUTATED} AS m FROM cons)
    {_columns(nuc, misnamed)}"""


TABLES = ("lineitem", "part", "supplier", "nation", "region")


def _bound(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    for t, df in tables.items():
        df.createOrReplaceTempView(f"_rv_{t}")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM _rv_{t}").replace(f"JOIN {t} ", f"JOIN _rv_{t} ")
    return spark.sql(text)


#: What a sequence hangs on: the species' part, genus and marker, the place and base that its record changes, and how its
#: ends or middle are. Records that agree in these have one sequence: at most 24 * 120 * 5 texts, at any number of rows.
_KIND = """((pk % 12) * 2 + CAST(marker_code = '16S' AS INT)) * 600 + (rid % 120) * 5
           + CASE WHEN rid % 97 = 0 THEN 0 WHEN rid % 7 = 0 THEN 1 WHEN rid % 11 = 0 THEN 2 WHEN rid % 31 = 0 THEN 3 ELSE 4 END"""


def _joined(spark: SparkSession, name: str, tables: dict[str, DataFrame], rid: str, base: str) -> DataFrame:
    """Rows with what their columns are made of, written once a session. A row is some twenty bytes without its sequence;
    each query makes only the columns that it names."""
    text = f"WITH {_thin(rid, base)} SELECT * FROM j"
    return materialize(_spread(spark, _bound(spark, text, tables), "rid").withColumn("kind", F.expr(_KIND).cast("long")), name)


def _texts(spark: SparkSession, rows: DataFrame, name: str, nuc: str) -> DataFrame:
    """(kind, nuc): the sequence of the first record of each kind."""
    hangs = ["spk", "pk", "marker_code"]
    first = rows.groupBy("kind", "spk", "marker_code", F.expr("pk % 4").alias("pk")).agg(F.min("rid").alias("rid"))  # (pk % 4) % 4 is pk % 4
    first = materialize(first, f"{name}_kinds")
    # Each step is a small table: one expression put into the next would outgrow what Spark compiles.
    whole = materialize(first.select(*hangs).distinct().withColumn("c0", F.expr(_whole())), f"{name}_whole")
    mutated = materialize(first.join(F.broadcast(whole), hangs).selectExpr("kind", "rid", f"{_MUTATED} AS m"), f"{name}_changed")
    return materialize(mutated.selectExpr("kind", f"{nuc} AS nuc"), name)


def _view(spark: SparkSession, rows: DataFrame, texts: DataFrame, misnamed: str = "") -> DataFrame:
    return _bound(spark, _columns("nuc", misnamed), {"mut": rows.join(F.broadcast(texts), "kind")})


def _spread(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    """Thin rows over all cores, before sequences make each some ten times as wide."""
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def table_paths(sf_dir: str, names: tuple[str, ...] = TABLES) -> list[str]:
    return [f"{sf_dir}/{t}.parquet" for t in names]


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        tables = _tables(spark, sf_dir)
        kept = ["l_partkey", "l_suppkey", "l_returnflag"]
        lines = numbered(tables["lineitem"].select(*ORDER), list(ORDER), "rid", keep=kept)
        return _joined(spark, "lines", tables | {"lineitem": lines}, "rid", _LINES)

    return once(spark, "lines", table_paths(sf_dir), build)


def _of_lines(spark: SparkSession, sf_dir: str, name: str, nuc: str, misnamed: str = "") -> DataFrame:
    """A view with a row per line item."""
    rows = _lines(spark, sf_dir)
    return _view(spark, rows, once(spark, name, table_paths(sf_dir), lambda: _texts(spark, rows, name, nuc)), misnamed)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_lines(spark, sf_dir, "records", _RAW)


#: Some aligned records stand under another species' name.
_MISNAMED = "WHEN rid % 4001 = 5 THEN 'Genusb epithetb'"


def aligned_sql() -> str:
    """The records with aligned sequences."""
    return record_sql(nuc=_ALIGNED, misnamed=_MISNAMED)


def aligned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_lines(spark, sf_dir, "aligned_records", _ALIGNED, _MISNAMED)


_SUPPLIERS = ("CAST(s_suppkey AS BIGINT) AS rid", "s_suppkey AS pk, s_suppkey AS sk, CASE WHEN s_suppkey % 3 = 0 THEN 'R' ELSE 'N' END AS rf FROM supplier")
_MISTAKEN = "WHEN rid % 29 = 5 THEN 'Genusb epithetb'"


def specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> tuple[DataFrame, DataFrame]:
        rows = _joined(spark, "suppliers", _tables(spark, sf_dir), *_SUPPLIERS)
        return rows, _texts(spark, rows, "specimens", _ALIGNED)

    return _view(spark, *once(spark, "specimens", table_paths(sf_dir), build), _MISTAKEN)
