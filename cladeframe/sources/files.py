"""Raw tab-separated exports and FASTA files as DataFrames. Both are read by Spark in splits, never whole."""

from __future__ import annotations

import re
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def field_name(header: str) -> str:
    return re.sub(r"\W", "_", header.strip()).lower()


def likeness(a: str, b: str) -> float:
    """0 to 1: the common beginning's share of the longer name, or the names' common pairs of letters (Dice), whichever
    is more. A name that begins with another is always at least somewhat like it."""
    longer = max(len(a), len(b), 1)
    begun = len(commonprefix([a, b]))
    pairs = [{s[k : k + 2] for k in range(len(s) - 1)} for s in (a, b)]
    common = 2 * len(pairs[0] & pairs[1]) / max(1, len(pairs[0]) + len(pairs[1]))
    return max(begun / longer, common, 0.5 if begun == min(len(a), len(b)) > 0 else 0.0)


def resolve_fields(header: list[str], wanted: list[str], required: list[str], least: float = 0.5) -> dict:
    """Places of the wanted fields in a header, found by name: {places, missing, missing_required, added, hints}.

    The first of equal headers counts; a hint is the unasked header most like a missing field (ties: the shortest)."""
    at: dict[str, int] = {}
    for k, h in enumerate(header):
        at.setdefault(field_name(h), k)
    key = {w: field_name(w) for w in wanted}
    missing = [w for w in wanted if key[w] not in at]
    added = sorted(at.keys() - set(key.values()))
    ranked = {w: min(((-likeness(key[w], a), len(a), a) for a in added), default=(0.0, 0, "")) for w in missing}
    return {
        "places": {w: at[k] for w, k in key.items() if k in at}, "missing": missing, "missing_required": [w for w in missing if w in required],
        "added": added, "hints": {w: a for w, (score, _, a) in ranked.items() if -score >= least},
    }


def raw_lines(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Header and lines (value) of tab-separated text without quoting; every file starts with the header."""
    lines = spark.read.text(path)
    first = lines.first()
    if first is None:
        return [], lines
    return first["value"].split("\t"), lines.where(F.col("value") != first["value"])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(at, header, sequence): a record goes from a line that begins with > to the next; `at` grows in file order. Files
    begin with a header; blank lines are skipped."""
    whole = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^>|\r", "").alias("v"))
    head = F.substring_index("v", "\n", 1)
    rest = F.regexp_replace(F.substr(F.col("v"), F.length(head) + 1), r"\s", "")
    return whole.select("at", F.trim(head).alias("header"), rest.alias("sequence")).where("header <> '' or sequence <> ''")


# How marker codes begin, words that stand for an epithet, and words after a name that are none.
MARKER = r"(?i)^(CO[IX]|CYTB|ND\d|ATP\d|RBCL|MATK|ITS|5-8S|12S|16S|18S|28S|D-LOOP|TRN|PSB|RPO|H3|RAG\d|RHO|WNT|EF1|CAD)"
FOLLOWED, ALONE = ("cf.", "aff.", "cf", "aff"), ("sp.", "sp")
NO_EPITHET = (
    "voucher", "isolate", "specimen", "sample", "clone", "haplotype", "strain", "mitochondrion", "mitochondrial", "cytochrome", "partial",
    "complete", "genomic", "unverified", "uncultured",
)


def _is_marker(c: Column) -> Column:
    return c.rlike(MARKER) & ~c.rlike(r"^[A-Z][a-z]+([\s_]|$)")


def _species_in(words: Column) -> Column:
    """Genus and epithet at the start of words, or null."""
    genus, second, third = (F.get(words, k) for k in range(3))
    low = F.lower(second)
    name = r"^[a-z][a-z-]{2,}$"
    said = (
        F.when(low.isin(*ALONE), F.concat(genus, F.lit(" sp.")))
        .when(low.isin(*FOLLOWED), F.when(third.rlike(name), F.concat_ws(" ", genus, second, third)))
        .when(second.rlike(name) & ~low.isin(*NO_EPITHET), F.concat_ws(" ", genus, second))
    )
    return F.when(genus.rlike(r"^[A-Z][a-z]{2,}$"), said)


def parse_headers(df: DataFrame, header: str = "header") -> DataFrame:
    """Adds id, species, genus, taxon, bin, sampleid and marker read from FASTA headers of five dialects.

    id|sample|bin|taxon|marker, id|taxon|marker|..., id|bin or sample|taxon|marker, an identifier and a name in words, and
    a name joined to an identifier by underscores. What is not said is null."""
    h = F.trim(F.col(header))
    p = F.transform(F.split(h, r"\|"), lambda x: F.trim(x))
    n = F.size(p)
    part = [F.get(p, k) for k in range(5)]
    own = (n >= 3) & (F.upper(part[2]).startswith("BOLD:") | (part[2] == ""))
    short = ~own & (n >= 3) & _is_marker(part[2])
    old = ~own & ~short & (n == 4) & _is_marker(part[3])
    words = F.split(h, r"\s+")
    plain = F.filter(F.slice(words, 2, 10000), lambda w: ~w.endswith(":"))
    loose = F.coalesce(_species_in(plain), _species_in(F.split(F.get(words, 0), "_")))
    field = F.trim(F.replace(F.when(own, part[3]).when(short, part[1]).when(old, part[2]), F.lit("_"), F.lit(" ")))
    named = field.rlike(r"^\p{Lu}\S*\s+\p{Ll}")
    bin_ = F.when(own, part[2]).when(old & F.upper(part[1]).startswith("BOLD:"), part[1])
    species = F.when(own | short | old, F.when(named, field)).when(n == 1, loose)
    return df.select(
        "*", F.when(n > 1, part[0]).otherwise(F.get(words, 0)).alias("id"), species.alias("species"), F.substring_index(species, " ", 1).alias("genus"),
        F.when((field != "") & ~named, field).alias("taxon"), bin_.alias("bin"),
        F.when(own, part[1]).when(old & ~F.upper(part[1]).startswith("BOLD:"), part[1]).alias("sampleid"),
        F.when(own, part[4]).when(short, part[2]).when(old, part[3]).alias("marker"),
    )
