"""Document fingerprints by winnowing.

Hashes of GRAM consecutive words roll over the text; of each WINDOW of them the least is selected, the rightmost of
equals, with its position. Two texts that share GRAM + WINDOW - 1 words in a row thus share a selected hash at the
matching positions. A selected hash is one long: 35 bits of hash above, and below the index counted down from 2^28 - 1,
so that the plain minimum of a window is its rightmost least hash.

Cases: a null text is empty; a text with fewer words than a gram is one gram, one without words has an empty
fingerprint; a text with fewer grams than a window selects one; equal texts have equal fingerprints; two empty
fingerprints are alike (1.0), an empty and another are not (0.0); rows with equal ids are ordered by text hash; a null id
comes last; in a table of one row the next document is the row itself; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words

GRAM, WINDOW = 5, 12
_LOW = (1 << 28) - 1
#: Range buckets of ids for finding each document's neighbour: as many as leave about this many documents to each. A
#: bucket is sorted by one task, and spills. Cuts are quantiles up to this number; between two of them, equal widths.
DOCS_A_BUCKET, CUTS = 10_000, 1024


def winnow(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds the selected hashes of column `text` to df as array<long>, in order of position."""
    df = df.withColumn("_w", words(F.col(text)))
    heads = F.slice("_w", F.lit(1), F.greatest(F.size("_w") - gram + 1, F.least(F.size("_w"), F.lit(1))))
    packed = lambda x, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(x, *[F.get("_w", i + k) for k in range(1, gram)]), 29), 28).bitwiseOR((F.lit(_LOW) - i).cast("long"))
    df = df.withColumn("_g", F.transform(heads, packed))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_g") - window + 1, F.lit(1)))
    least = F.array_distinct(F.transform(starts, lambda s: F.array_min(F.slice("_g", s, window))))
    return df.withColumn(out, F.when(F.size("_g") > 0, least).otherwise(F.array().cast("array<long>"))).drop("_w", "_g")


def hashes(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda p: F.shiftrightunsigned(p, 28)))


def as_text(selected: Column) -> Column:
    """hash:position, in order of position."""
    return F.array_join(F.transform(selected, lambda p: F.concat_ws(":", F.lower(F.hex(F.shiftrightunsigned(p, 28))), (F.lit(_LOW) - p.bitwiseAND(F.lit(_LOW).cast("long"))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared hashes over all hashes of both (Dice)."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1)))


def _bucket_of(x: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are at or below x, looked up in two steps."""
    step = 64
    if len(cuts) <= step:
        return F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= x))
    tops = F.array(*[F.lit(c) for c in cuts[::step]])
    chunks = F.array(*[F.array(*[F.lit(c) for c in cuts[k : k + step]]) for k in range(0, len(cuts), step)])
    top = F.size(F.filter(tops, lambda c: c <= x))
    return F.when(top == 0, 0).otherwise((top - 1) * step + F.size(F.filter(F.get(chunks, top - 1), lambda c: c <= x)))


def with_next(df: DataFrame, key: str, tie: str, cols: list[str]) -> DataFrame:
    """Adds next_<col>: the columns of the next row by descending key; the first row's after the last.

    Rows go to range buckets of the key. The first row of each bucket is also sent, as a ghost, to the bucket above it,
    so that a window over one bucket finds every neighbour and no row is read twice.
    """
    spark = df.sparkSession
    rank = F.coalesce(F.col(key), F.lit(-(1 << 63))).cast("double")
    n, low, high = df.select(rank.alias("x")).agg(F.count("*"), F.min("x"), F.max("x")).first()
    buckets = max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n // DOCS_A_BUCKET)
    tops = min(buckets, CUTS)
    probs = [k / tops for k in range(1, tops)]
    cuts = sorted(set(df.select(rank.alias("x")).approxQuantile("x", probs, 0.2 / tops))) if n and probs else []
    bucket = F.lit(0).cast("long")
    if cuts:
        parts = -(-buckets // tops)
        top, edges = _bucket_of(rank, cuts), F.array(*map(F.lit, [low, *cuts, high]))
        width = F.get(edges, top + 1) - F.get(edges, top)
        part = F.when(width > 0, F.least(F.floor((rank - F.get(edges, top)) / width * parts), F.lit(parts - 1))).otherwise(0)
        bucket = top * F.lit(parts).cast("long") + part
    # One row per bucket: its number, its greatest key, and the bucket above it.
    heads = sorted((r["b"], r["x"]) for r in df.select(rank.alias("x"), bucket.alias("b")).groupBy("b").agg(F.max("x").alias("x")).collect())
    above = [(b, x, heads[(k + 1) % len(heads)][0]) for k, (b, x) in enumerate(heads)]
    tied = F.broadcast(spark.createDataFrame(above, "_b long, _head double, _above long"))
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("ghost"))
    ghost = F.when(F.col("_head") == F.col("_x"), F.struct(F.col("_above").alias("b"), F.lit(1).alias("ghost")))
    dealt = df.withColumn("_x", rank).withColumn("_b", bucket).join(tied, "_b").withColumn("_at", F.explode(F.array_compact(F.array(own, ghost))))
    w = Window.partitionBy("_at.b").orderBy(F.col("_at.ghost"), F.col(key).desc_nulls_last(), F.col(tie))
    led = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in cols])
    return led.where("_at.ghost = 0").drop("_x", "_b", "_head", "_above", "_at")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    df = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    df = winnow(df.withColumn("_th", F.xxhash64("_t")), "_t", "_f")
    df = with_next(df, "doc_id", "_th", ["_t", "_f"])
    half = F.floor(F.length("_t") / 2).cast("int")
    df = df.withColumn("_e", F.concat(F.left("_t", F.length("_t") - half), F.left("next__t", half)))
    df = winnow(df, "_e", "_ef")
    df = df.withColumn("_h", hashes(F.col("_f")))
    return df.select(
        "doc_id", F.length("_t").cast("long").alias("n_chars"), F.sha2("_e", 256).alias("edited_sha256"),
        as_text(F.col("_f")).alias("fingerprint"), as_text(F.col("_ef")).alias("edited_fingerprint"),
        likeness(F.col("_h"), hashes(F.col("_ef"))).alias("near_edited"), likeness(F.col("_h"), hashes(F.col("next__f"))).alias("near_next"),
    )
