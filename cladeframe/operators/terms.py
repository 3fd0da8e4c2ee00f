"""Lists of terms as users paste them: their one form each, where they match, and what a report says of each."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import LETTERS
from ..functions.text import fold, fold_text


def plain(text: str) -> str:
    """Letters without accents."""
    apart = unicodedata.normalize("NFD", "".join(LETTERS.get(c, c) for c in text))
    return unicodedata.normalize("NFC", "".join(c for c in apart if not unicodedata.combining(c)))


def taxon(text: str) -> str:
    """A pasted name: underscores as spaces, single spaces, the first letter capital."""
    words = text.replace("_", " ").split()
    return " ".join([words[0].capitalize(), *words[1:]]) if words else ""


def term_table(spark: SparkSession, pasted: list[str], taxonomy: bool = False) -> DataFrame:
    """(term, value): each term once, without accents, with the values to look for. Terms that differ in case or accents
    are one; terms beyond ASCII are also looked for as written, in lower and in upper case. A request's list is short."""
    named: dict[str, str] = {}
    pairs: dict[tuple[str, str], tuple[str, str]] = {}
    for raw in pasted:
        cleaned = taxon(raw or "") if taxonomy else (raw or "").strip()
        term = plain(cleaned)
        if term:
            term = named.setdefault(term.lower(), term)
            for value in (plain(cleaned), cleaned, *([] if cleaned.isascii() else [cleaned.lower(), cleaned.upper()])):
                pairs.setdefault((term, fold_text(value)), (term, value))
    return spark.createDataFrame(sorted(pairs.values()), "term string, value string")


def match_taxa(df: DataFrame, terms: DataFrame, rid: str, species: str, above: list[str], below: str | None = None) -> DataFrame:
    """(rid, term), each once: every term is looked for among species, terms of one word also in the ranks above, terms of
    several also in the rank below. One equi-join over unpivoted ranks."""
    one, more = F.lit(1), F.lit(2)
    ranks = [F.struct(F.lit(0).alias("words"), fold(F.col(species)).alias("k")), *[F.struct(one.alias("words"), fold(F.col(c)).alias("k")) for c in above]]
    if below:
        ranks.append(F.struct(more.alias("words"), fold(F.col(below)).alias("k")))
    long = df.select(F.col(rid), F.explode(F.array(*ranks)).alias("x")).select(rid, "x.*").where("k is not null")
    keys = terms.select("term", fold(F.col("value")).alias("k"), F.when(F.contains("value", F.lit(" ")), 2).otherwise(1).alias("of"))
    return long.join(keys, "k").where("words = 0 or words = of").select(rid, "term").distinct()


def metric_lists(df: DataFrame, matches: DataFrame, rid: str, columns: list[str], most: int = 0, with_counts: bool = True) -> DataFrame:
    """(term, column, n_values, listed): per term and column its distinct values, by frequency and then name; with `most`
    above zero, the first of them and how many more there are."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")
    counts = df.join(matches, rid).select("term", each).select("term", "x.*").where("value <> ''").groupBy("term", "column", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("term", "column").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("k", F.row_number().over(w))
    said = F.concat("value", F.lit(" ("), F.format_number("n", 0), F.lit(")")) if with_counts else F.col("value")
    shown = F.when(F.col("k") <= most, F.struct("k", said.alias("s"))) if most else F.struct("k", said.alias("s"))
    out = ranked.groupBy("term", "column").agg(F.count("*").alias("n_values"), F.array_sort(F.collect_list(shown)).alias("l"))
    rest = F.col("n_values") - F.size("l")
    listed = F.array_join(F.transform("l", lambda x: x["s"]), "; ")
    return out.select("term", "column", "n_values", F.when(rest > 0, F.concat(listed, F.lit("; and "), F.format_number(rest, 0), F.lit(" more"))).otherwise(listed).alias("listed"))


def second_field_summary(terms: DataFrame, values: list[str], found: DataFrame, rid: str) -> DataFrame:
    """(value2, records, found, not_found) for each value of a request's short second list; `found` has (rid, term,
    value2)."""
    every = terms.select("term").distinct().agg(F.count("*").alias("every"))
    each = found.groupBy("value2", "term").agg(F.count_distinct(rid).alias("n")).groupBy("value2").agg(F.sum("n").alias("records"), F.count("*").alias("found"))
    own = found.sparkSession.createDataFrame([(v,) for v in values], "value2 string").join(each, "value2", "left").join(F.broadcast(every))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.select("value2", zero("records"), zero("found"), (F.col("every") - F.coalesce("found", F.lit(0))).alias("not_found"))
