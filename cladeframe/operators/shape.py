"""What a request may ask of the record table: columns, markers, ids, caps, reports; and records that come with it."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPS, fold, fold_text, null_if_blank

#: A word that may be a record's id or its beginning: letters and digits, five or more.
ID_WORD = re.compile(r"(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9._-]{5,}")


def chosen_columns(df: DataFrame, wanted: list[str] | None = None, without: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> DataFrame:
    """The wanted columns in the wanted order, unknown names left out; all columns if none is wanted. Those of `without`
    are dropped; those of `optional` that the table lacks are null."""
    names = [c for c in dict.fromkeys(wanted or df.columns) if c in df.columns and c not in without]
    return df.select(*[F.col(f"`{c}`") for c in names], *[F.lit(None).cast("string").alias(c) for c in optional if c not in df.columns])


def of_marker(df: DataFrame, column: str, marker: str | None, sequence: str | None = None) -> DataFrame:
    """Records of a marker, whatever its case; those without one for an empty marker; all for none. With `sequence`, only
    records that have one."""
    if marker is not None:
        df = df.where(F.coalesce(fold(F.col(column)), F.lit("")) == fold_text(marker))
    return df if sequence is None else df.where(F.col(sequence) != "")


def text_or_id(found: Column, query: str, processid: str) -> Column:
    """The text match, or, for a query of one word that looks like an id, records whose id begins with it."""
    word = query.strip().strip('"')
    return found | F.coalesce(F.col(processid).startswith(word), F.lit(False)) if ID_WORD.fullmatch(word) else found


def capped(df: DataFrame, most: int, by: list[str]) -> tuple[DataFrame, bool]:
    """The first `most` rows, and whether there are more: one row beyond the cap is looked for."""
    rows = df.orderBy(*by).limit(most + 1)
    return rows.limit(most), rows.count() > most


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_values) without blanks, all columns in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("v")) for c in columns])).alias("x")
    return df.select(each).select("x.*").groupBy("column").agg(F.count_distinct("v").alias("n_values"))


def group_sizes(df: DataFrame, columns: list[str], big: int = 20) -> DataFrame:
    """(column, filled, groups, big_groups): records with a value, its values, and those of `big` records or more."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("v")) for c in columns])).alias("x")
    counts = df.select(each).select("x.*").where("v is not null").groupBy("column", "v").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg(F.sum("n").alias("filled"), F.count("*").alias("groups"), F.count_if(F.col("n") >= big).alias("big_groups"))


def client_records(spark: SparkSession, given: list[dict], keys: list[str]) -> DataFrame:
    """Records that came with a request: known keys, blanks as null, records without any left out."""
    rows = [tuple(str(r[k]).strip() or None if r.get(k) is not None else None for k in keys) for r in given]
    return spark.createDataFrame([r for r in rows if any(r)], ", ".join(f"`{k}` string" for k in keys))


def qualifiers(features: Column) -> Column:
    """(source, marker) of an array of features (key, quals: array of (name, value)): the first value of each qualifier of
    the source, as a map, and the gene, else the product, of the first other feature that has one; else empty."""
    first = lambda quals, name: F.nullif(F.trim(F.get(F.filter(quals, lambda q: q["name"] == name), 0)["value"]), F.lit(""))
    source = F.get(F.filter(features, lambda f: f["key"] == "source"), 0)["quals"]
    known = F.filter(F.coalesce(source, F.array()), lambda q: F.coalesce(q["name"] != "", F.lit(False)))
    names = F.array_distinct(F.transform(known, lambda q: q["name"]))
    table = F.map_from_arrays(names, F.transform(names, lambda n: F.coalesce(F.trim(F.get(F.filter(known, lambda q: q["name"] == n), 0)["value"]), F.lit(""))))
    said = F.transform(F.filter(features, lambda f: f["key"] != "source"), lambda f: F.coalesce(first(f["quals"], "gene"), first(f["quals"], "product")))
    return F.struct(table.alias("source"), F.coalesce(F.get(F.array_compact(said), 0), F.lit("")).alias("marker"))


def criteria(first: list[str], second: list[str]) -> list[tuple[str, str | None]]:
    """Each term of a request's first list with each of its second; with none where that is empty."""
    def tidy(terms: list[str]) -> list[str]:
        held = {" ".join((t or "").replace("_", " ").split()) for t in terms} - {""}
        by: dict[str, str] = {}
        for t in terms:
            name = " ".join((t or "").replace("_", " ").split())
            if name in held:
                by.setdefault(name.lower(), name)
        return list(by.values())

    return [(a, b) for a in tidy(first) for b in tidy(second) or [None]]


@dataclass(frozen=True)
class Report:
    """Which values a batch report counts and lists; made by `report_of` from what a request says."""

    metrics: dict[str, tuple[bool, bool]] = field(default_factory=dict)  # column: count, list
    breakdowns: tuple[str, ...] = ()
    with_counts: bool = False
    most: int = 0


def report_of(said: dict | None, allowed: list[str]) -> Report:
    """Unknown and repeated columns, and metrics that ask for nothing, are left out; a list length that is no number is 0."""
    said = said or {}
    metrics: dict[str, tuple[bool, bool]] = {}
    for m in said.get("metrics") or []:
        if isinstance(m, dict) and m.get("column") in allowed and m["column"] not in metrics and (m.get("count") or m.get("list")):
            metrics[m["column"]] = bool(m.get("count")), bool(m.get("list"))
    most = str(said.get("max_list") or 0)
    return Report(metrics, tuple(c for c in dict.fromkeys(said.get("breakdowns") or []) if c in allowed), bool(said.get("with_counts")), int(most) if most.isdecimal() else 0)


def forced_code(said: object) -> int | None:
    """The genetic code that a request forces; None for automatic. Raises for a number that is no table."""
    if said in (None, "", "auto"):
        return None
    if not str(said).isdecimal() or int(str(said)) not in STOPS:
        raise ValueError(f"no genetic code: {said}")
    return int(str(said))


def thresholds_of(said: dict | None, usual: dict[str, float]) -> dict[str, float]:
    """Thresholds by level, the usual ones where none is said; each from 0.5 to 1, none above a finer level's."""
    out = {k: float(v if (said or {}).get(k) is None else (said or {})[k]) for k, v in usual.items()}
    finer = list(out.values())
    if not all(0.5 <= v <= 1 for v in finer) or any(a < b for a, b in zip(finer, finer[1:])):
        raise ValueError(f"bad thresholds: {out}")
    return out


def plan_text(df: DataFrame) -> str:
    """The formatted plan of a query."""
    held = io.StringIO()
    with redirect_stdout(held):
        df.explain("formatted")
    return held.getvalue()


def blank_to_null(df: DataFrame) -> DataFrame:
    """Text columns with the empty text and None as null."""
    return df.select(*[null_if_blank(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
