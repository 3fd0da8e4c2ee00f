"""Text rules of the record table as Columns: ASCII case folding, lenient numbers, matching, names."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(c: Column) -> Column:
    """Comparison key: only A-Z are folded, so É and é stay apart."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def fold_text(s: str) -> str:
    return s.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def lenient_double(c: Column) -> Column:
    """Longest numeric prefix as a number; 0 without one; null stays null."""
    number = F.regexp_extract(F.trim(c), r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(number.try_cast("double"), F.lit(0.0)))


def like_anywhere(c: Column, value: str, head: bool = False, tail: bool = False) -> Column:
    """Substring, prefix or suffix match by folded text; % and _ in the value are wildcards."""
    v = fold_text(value)
    if "%" in v or "_" in v:
        pattern = "".join(".*" if x == "%" else "." if x == "_" else re.escape(x) for x in v)
        return fold(c).rlike("(?s)" + ("^" if head else "") + pattern + ("$" if tail else ""))
    k = fold(c)
    return k.startswith(v) if head else k.endswith(v) if tail else k.contains(v)


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def null_if_blank(c: Column) -> Column:
    """Empty text and the literal None are missing."""
    return F.when((c == "") | (c == "None"), None).otherwise(c)


def best_taxon(*ranks: Column) -> Column:
    """The first rank with a name, with spaces as underscores."""
    return F.replace(F.coalesce(*[F.when(F.trim(r) != "", F.trim(r)) for r in ranks]), F.lit(" "), F.lit("_"))


def clean_sequence(c: Column) -> Column:
    """Upper case, no gaps, dots or white space, U as T, no N at either end."""
    # Most are letters in upper case already, which one greedy match tells.
    letters = F.when(c.rlike(r"\A[A-Z]*+\z"), c).otherwise(F.upper(F.regexp_replace(c, r"[-.\s]", "")))
    return F.btrim(F.replace(letters, F.lit("U"), F.lit("T")), F.lit("N"))


def reverse_complement(c: Column) -> Column:
    # Complements of the nucleotide codes (S, W and N are their own).
    return F.reverse(F.translate(c, "ACGTRYKMBVDH", "TGCAYRMKVBHD"))


#: Stop codons of the genetic codes, by table number.
STOPS = {1: ("TAA", "TAG", "TGA"), 2: ("TAA", "TAG", "AGA", "AGG"), 4: ("TAA", "TAG"), 5: ("TAA", "TAG"), 9: ("TAA", "TAG"), 11: ("TAA", "TAG", "TGA"), 13: ("TAA", "TAG")}


def stop_count(seq: Column, frame: int, code: int = 5) -> Column:
    """Stop codons in a forward frame; the last whole codon never counts."""
    stop = "|".join(STOPS[code])
    # One match a stop: \G goes on where the last match ended, so that matches stay in frame; nothing is tried twice.
    return F.regexp_count(F.substr(seq, F.lit(frame + 1)), F.lit(rf"\G(?:(?!{stop})...)*+(?:{stop})(?=...)"))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))
