"""Names, places, coordinates and free text of records, as Columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a name as no settled species.
PROVISIONAL = r"(?i)\b(sp|spp|cf|aff|nr|gr|complex|indet)\b\.?|\d|\s[x×]\s|\?|(?-i:^\S+\s+\S+\s+[A-Z])"

# Spaces that become a plain space, quotes that become an apostrophe.
ODD_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u205f\u3000\ufeff"
ODD_QUOTES = "\u2018\u2019\u02bb\u02bc\u2032"

# Latin letters that no decomposition takes to ASCII.
LETTERS = {
    "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ı": "i", "İ": "I", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ŧ": "t", "Ŧ": "T",
    "ħ": "h", "Ħ": "H", "ŋ": "n", "Ŋ": "N", "ĸ": "k", "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE",
    "þ": "th", "Þ": "TH",
}


def _accented() -> tuple[str, str]:
    """Letters below U+2000 that decompose into one base letter and marks, and those base letters."""
    pairs = [(chr(x), unicodedata.normalize("NFD", chr(x))) for x in range(0xC0, 0x2000)]
    held = [(c, d[0]) for c, d in pairs if len(d) > 1 and c not in LETTERS and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in held), "".join(b for _, b in held)


def repair_mojibake(c: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; anything else stays."""
    again = F.try_validate_utf8(F.encode(F.when(c.rlike(r"^[\x00-\xff]*$"), c), "ISO-8859-1").cast("string"))
    return F.coalesce(again, c)


def strip_accents(c: Column) -> Column:
    """Latin, Greek and Cyrillic letters without their marks; other scripts stay."""
    single = {k: v for k, v in LETTERS.items() if len(v) == 1}
    accented, base = _accented()
    out = F.translate(c, "".join(single) + accented, "".join(single.values()) + base)
    for k, v in LETTERS.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return F.regexp_replace(out, r"\p{Mn}", "")


def normalize_text(c: Column) -> Column:
    """Free text as it is stored: repaired, plain spaces and apostrophes, no accents, trimmed. ASCII is only trimmed."""
    plain = F.translate(repair_mojibake(c), ODD_SPACES + ODD_QUOTES, " " * len(ODD_SPACES) + "'" * len(ODD_QUOTES))
    text = F.when(c.rlike(r"[^\x00-\x7f]"), strip_accents(plain)).otherwise(c)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def provisional(c: Column) -> Column:
    return c.rlike(PROVISIONAL)


def settled(c: Column) -> Column:
    """The species name, or null if it is blank or provisional."""
    return F.when((F.trim(c) != "") & ~provisional(c), c)


def epithet(c: Column) -> Column:
    """The second word of a name if it is all lower case letters."""
    second = F.get(F.split(F.trim(c), r"\s+"), 1)
    return F.when(second.rlike(r"^\p{Ll}+$"), second)


def taxon_term(c: Column) -> Column:
    """A searched name: underscores as spaces, single spaces, the first word capitalised."""
    t = F.trim(F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), r"\s+", " "))
    head = F.substring_index(t, " ", 1)
    return F.concat(F.initcap(head), F.substr(t, F.length(head) + 1))


def coordinates(c: Column) -> Column:
    """struct(lat, lon) of two numbers in a text; null without them or out of range."""
    pair = r"(-?[0-9]+(?:\.[0-9]+)?)\s*[,;\s]\s*(-?[0-9]+(?:\.[0-9]+)?)"
    lat, lon = (F.regexp_extract(c, pair, k).try_cast("double") for k in (1, 2))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def grid_zone(lat: Column, lon: Column) -> Column:
    """Label of the one-degree cell: 12°N 77°W."""
    y, x = F.floor(lat), F.floor(lon)
    side = lambda v, a, b: F.concat(F.abs(v).cast("string"), F.lit("°"), F.when(v >= 0, a).otherwise(b))
    return F.concat_ws(" ", side(y, "N", "S"), side(x, "E", "W"))


def place_zone(place: Column, country: Column) -> Column:
    """A province or region with its country, since names repeat across countries."""
    p, c = F.trim(place), F.trim(country)
    return F.when((p != "") & (c != ""), F.concat(p, F.lit(" ("), c, F.lit(")"))).otherwise(p)


# Markers that are translated, by kind.
MITOCHONDRIAL = ("COI-5P", "COI-3P", "COI-5P3P", "COII", "COIII", "COXIII", "CYTB", "ATP6", "ATP8", "ND1", "ND2", "ND3", "ND4", "ND4L", "ND5", "ND5-0", "ND6", "MATR")
PLASTID = ("RBCL", "RBCLA", "MATK", "TUFA", "RPOB", "RPOC1", "PSBA", "PSBA-3P", "YCF1", "COXA", "WSP", "FBPA", "HCPA")
NUCLEAR = ("H3", "RAG1", "RAG2", "RHO", "WNT1", "MC1R")
# Mitochondrial code by class, then phylum, then kingdom; 5 where none says.
CLASS_CODE = {"ascidiacea": 13, "thaliacea": 13, "appendicularia": 13, "larvacea": 13, "leptocardii": 5}
PHYLUM_CODE = {"chordata": 2, "echinodermata": 9, "hemichordata": 9, "platyhelminthes": 9, "cnidaria": 4, "porifera": 4, "ctenophora": 4, "placozoa": 4}
KINGDOM_CODE = {"fungi": 4, "protista": 4}


def marker_kind(marker: Column) -> Column:
    """mito, plastid, nuclear or noncoding; null for no marker."""
    m = F.upper(F.trim(marker))
    return F.when(m.isin(*MITOCHONDRIAL), "mito").when(m.isin(*PLASTID), "plastid").when(m.isin(*NUCLEAR), "nuclear").when(m != "", "noncoding")


def genetic_code(marker: Column, klass: Column, phylum: Column, kingdom: Column) -> Column:
    """Number of the translation table; null where a sequence is not translated. Plants' mitochondria use table 1."""
    def said(c: Column, codes: dict[str, int]) -> Column:
        name = F.lower(F.trim(c))
        out = F.lit(None).cast("int")
        for k, v in codes.items():
            out = F.when(name == k, v).otherwise(out)
        return out

    kind = marker_kind(marker)
    mito = F.coalesce(said(klass, CLASS_CODE), said(phylum, PHYLUM_CODE), said(kingdom, KINGDOM_CODE | {"plantae": 1}), F.lit(5))
    return F.when(kind == "plastid", 11).when(kind == "nuclear", 1).when(kind == "mito", mito)
