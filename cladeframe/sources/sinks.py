"""Results as files: delimited text, FASTA, one folder per term. Spark writes all of them, part by part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import best_taxon, clean_sequence


def write_table(df: DataFrame, path: str, sep: str = ",", names: dict[str, str] | None = None) -> None:
    """Delimited text with a header in every part; nulls are empty. `names` gives columns the names readers know."""
    out = df.withColumnsRenamed(names or {})
    out.write.options(header=True, sep=sep, nullValue="", emptyValue="").csv(path)


def fasta_entry(record: str, sample: str, bin_: str, ranks: list[str], marker: str, sequence: str, least: int = 50) -> Column:
    """>id|sample|bin|taxon|marker and the sequence; empty places stay. Null under `least` bases or if nothing is said."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in (record, sample, bin_)]
    said += [F.coalesce(best_taxon(*[F.col(r) for r in ranks]), F.lit("")), F.coalesce(F.col(marker), F.lit(""))]
    head, seq = F.concat_ws("|", *said), clean_sequence(F.col(sequence))
    return F.when((F.length(seq) >= least) & (F.replace(head, F.lit("|"), F.lit("")) != ""), F.concat(F.lit(">"), head, F.lit("\n"), seq))


def write_fasta(df: DataFrame, entry: Column, path: str) -> None:
    df.select(entry.alias("value")).where("value is not null").write.text(path)


def folder_names(terms: DataFrame, term: str) -> DataFrame:
    """(term, folder): a folder for each term, its name with other characters than letters, digits, _, . and - as _; of
    terms that clean to one name, whatever their case, the later ones, by code points, get ~2, ~3 and so on, which no
    cleaned name holds."""
    clean = F.regexp_replace("term", r"[^\w.-]+", "_")
    each = terms.select(F.col(term).alias("term")).where("term is not null").distinct().withColumn("c", F.when(clean == "", "_").otherwise(clean))
    k = F.row_number().over(Window.partitionBy(F.lower("c")).orderBy("term"))
    return each.withColumn("k", k).select("term", F.when(F.col("k") > 1, F.concat("c", F.lit("~"), "k")).otherwise(F.col("c")).alias("folder"))


def write_terms(matches: DataFrame, term: str, path: str, names: DataFrame | None = None) -> None:
    """Tab-separated rows in one folder per term, written in one pass. A third of the rows may be one term's: rows are
    dealt over tasks as they come, not gathered by term. `names` are folder_names, if known already."""
    names = folder_names(matches, term) if names is None else names
    named = matches.join(names.select(F.col("term").alias(term), F.col("folder").alias("_term")), term)
    named.write.partitionBy("_term").options(header=True, sep="\t", nullValue="").csv(path)


def write_batch(matches: DataFrame, terms: DataFrame, term: str, path: str) -> None:
    """A request's whole result under path: its rows by term (`records`), which folder is whose with numbers of rows
    (`summary`), and the terms without any (`not_found`). `terms` is the request's list, and decides the folders."""
    names = folder_names(terms, term)
    write_terms(matches, term, f"{path}/records", names)
    counts = names.join(matches.groupBy(F.col(term).alias("term")).agg(F.count("*").alias("records")), "term", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    write_table(counts.where("records > 0").select("term", "folder", "records").orderBy("term"), f"{path}/summary", sep="\t")
    counts.where("records = 0").select("term").orderBy("term").write.text(f"{path}/not_found")
