"""Quality rules by cross-document line frequency.

Lines are normalised (lower case, words joined by one space) and hashed. Per host, the distinct documents that hold a
line are counted; a host is a `source`, and a document is a distinct pair of id and text. Lines in more documents than
the limits are boilerplate and removed; a document that keeps too small a part of its words is depleted and rejected, as
is one that fails the base rules. So a text that is copied to many documents of a host is rejected there.

Everything about one text is computed from its own words in one pass, with array functions; only line hashes travel.

Cases: a null text has no words and fails the base rules; a null host is a host of its own; lines without a word count
nowhere; repeated rows get one row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import WORD_BREAK, spread_join, text_key, words

SYMBOLS = r"[#*$%&|<>]"
#: A line is boilerplate on a host if over this many documents, and over this share of them, hold it.
MIN_DOCS, MAX_SHARE = 10, 0.002
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.5
_LOW = (1 << 28) - 1  # low bits of a sort key hold the window's index; texts have under 2^28 words


def repeated_words(df: DataFrame, w: str, out: str) -> DataFrame:
    """Adds to df: how many words of the array column w lie in 3-word windows that occur twice or more.

    Windows are sorted by hash as plain longs (36 hash bits, 28 index bits); those whose 36 bits meet are compared again
    by the full 64-bit hash.
    """
    low = F.lit(_LOW).cast("long")

    def window(i: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def twins(name: str, same) -> Column:
        return F.filter(name, lambda x, i: F.coalesce(same(x, F.get(name, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(name, i - 1)), F.lit(False)))

    heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    df = df.withColumn("_s", F.sort_array(F.transform(heads, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(~_LOW).bitwiseOR(i.cast("long")))))
    df = df.withColumn("_c", twins("_s", lambda x, y: x.bitwiseXOR(y).between(0, _LOW)))
    at = F.transform("_c", lambda x: x.bitwiseAND(low).cast("int"))
    df = df.withColumn("_c", F.sort_array(F.transform(at, lambda i: F.struct(window(i).alias("h"), i.alias("i")))))
    df = df.withColumn("_c", F.sort_array(F.transform(twins("_c", lambda x, y: x["h"] == y["h"]), lambda x: x["i"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
    return df.withColumn(out, F.aggregate("_c", start, step)["n"]).drop("_s", "_c")


def measure(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, host, text hash, the base numbers, and the lines with a word as (hash, words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("host"), text.alias("_t"), words(text).alias("_w"))
    df = repeated_words(df, "_w", "n_repeat_words")
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    lines = F.transform(
        F.transform("_lines", lambda x: F.array_remove(F.split(F.lower(x), WORD_BREAK), "")),
        lambda x: F.struct(F.xxhash64(F.array_join(x, " ")).alias("h"), F.size(x).alias("w")),
    )
    return df.select(
        "doc_id", "host", F.xxhash64("_t").alias("text_hash"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", lines.alias("lines"),
    )


_TEXT = ["host_key", "text_hash"]


def texts_of(measured: DataFrame) -> DataFrame:
    """Per text of a host: its lines, the documents that have it (n_docs), and the rows (n_rows)."""
    named = measured.withColumn("host_key", text_key(F.col("host")))
    each = named.groupBy(*_TEXT, "doc_id").agg(F.any_value("lines").alias("lines"), F.count("*").alias("n_rows"))
    return each.groupBy(*_TEXT).agg(F.any_value("lines").alias("lines"), F.count("*").alias("n_docs"), F.sum("n_rows").alias("n_rows"))


def common_lines(texts: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host_key, h, n_) of lines above the limits; n_ is the number of documents."""
    each = texts.select("host_key", "n_docs", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = each.groupBy("host_key", "h").agg(F.sum("n_docs").alias("n_")).where(F.col("n_") > min_docs)
    hosts = texts.groupBy("host_key").agg(F.sum("n_docs").alias("docs"))
    return counts.join(hosts, "host_key").where(F.col("n_") > F.col("docs") * max_share).select("host_key", "h", "n_")


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words_left."""
    measured = materialize(measure(docs), "measured")
    texts = materialize(texts_of(measured), "texts")
    common = materialize(common_lines(texts, min_docs, max_share), "common_lines")
    lines = texts.select(*_TEXT, "n_rows", F.explode("lines").alias("x")).select(*_TEXT, "n_rows", "x.h", "x.w")
    met = spread_join(lines, common, ["host_key", "h"], F.col("text_hash"))
    gone = met.groupBy(*_TEXT).agg(F.sum("w").alias("gone"), F.max("n_rows").alias("n_"))
    named = measured.drop("lines").withColumn("host_key", text_key(F.col("host")))
    both = spread_join(named, materialize(gone, "gone"), _TEXT, F.col("doc_id"), "left")
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left >= F.col("n_words") * least_left)).alias("kept"), left.alias("words_left"),
    )
