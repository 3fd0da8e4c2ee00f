"""Mixing sources to target weights along a time-varying curriculum.

A source's rate at training time t in [0, 1] is a straight line whose integral over [0, 1] is its target, so its demand
for words up to t is a quadratic. A document that starts at word c of its source's stream is due when that demand
reaches c: the quadratic solved for t is its training position. Targets share all words by weight; a target stops at
`epochs` times its source's size and the excess is shared again by weight.

Within its source, a document's place is by the MD5 of its id. Prefix sums are taken in two levels: within a bucket of
leading digits of that hash, and over the source's buckets. There are as many buckets as leave about BUCKET_ROWS rows to
each, so a source that holds a third of all rows is spread over its buckets at any size.

Cases: a null or blank text has size 0, a target share of 0 words taken and position 0 of its source's stream; a null
source is a source of its own, last in order; rows with equal ids are ordered by text hash, and rows equal in both are
interchangeable; repeated rows are mixed as rows of their own; an empty table gives an empty result; extra columns of any
name are kept by `expand`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import id_key, n_words, spread_join, text_key, whole_row

WEIGHTS = (5, 2, 1)
#: How far a source's rate leans: it starts at (1 + lean) and ends at (1 - lean) times its mean. Cycled like WEIGHTS.
LEANS = (0.5, 0.0, -0.5)
EPOCHS = 3
BUCKET_ROWS = 50_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight, lean, target) of (source, source_size), one row per source.

    Water filling: the level is what a unit of weight gets. Sources that it would fill over their limit are held at it,
    which raises the level for the rest; each round is one aggregate over the sources, until no more are held.
    """
    n = len(weights)
    ordered = sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), F.col("source"))
    placed = materialize(ordered.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")), "sources")
    per_part = {r["_p"]: r["n"] for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row per partition
    before, start = 0, []
    for p in sorted(per_part):
        start.append((p, before))
        before += per_part[p]
    starts = sizes.sparkSession.createDataFrame(start, "_p int, _start long")
    row = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_start")
    turn = F.pmod(row, F.lit(n)).cast("int")
    ranked = placed.join(F.broadcast(starts), "_p").select(  # a row per partition
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), turn + 1).alias("weight"),
        F.element_at(F.array(*map(F.lit, LEANS)), F.pmod(row, F.lit(len(LEANS))).cast("int") + 1).alias("lean"),
    )
    ranked = materialize(ranked, "weights")
    limit = F.col("source_size") * F.lit(epochs)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, held = None, -1
    while True:
        over = F.lit(False) if level is None else limit <= F.col("weight") * F.lit(level)
        r = ranked.agg(F.sum(F.when(over, limit)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("w"), F.count_if(over).alias("held")).first()
        if r["held"] == held or not r["w"]:
            break
        held = r["held"]
        level = (total - (r["full"] or 0)) / r["w"]
    return ranked.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(float(level or 0))))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: doc_id, _text_hash, source, size, source_size, target, taken, position.

    `taken` is in words: whole passes over the source, then documents in hash order until the target is reached, the
    last of them in part. `position` is when the document first comes up.
    """
    own = materialize(
        docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("text").alias("_text_hash"), n_words(F.col("text")).alias("size")), "sizes"
    )
    digits = max(2, math.ceil(math.log(max(1, own.count() / BUCKET_ROWS), 16)))
    at = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    hashed = own.withColumn("_h", at).withColumn("_b", F.left("_h", F.lit(digits))).withColumn("_s", text_key(F.col("source")))
    sums = materialize(hashed.groupBy("source", "_s", "_b").agg(F.sum("size").alias("n")), "bucket_sizes")
    per_source = sums.groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = materialize(source_targets(per_source, weights, epochs), "targets")
    past = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # the buckets of a source
    ahead = sums.select("_s", "_b", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_ahead"))
    # Each bucket gets its source's numbers, so that documents are joined by bucket, never by a whole source.
    ahead = ahead.join(targets.select(text_key(F.col("source")).alias("_s"), "source_size", "target", "lean"), "_s")
    w = Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "_text_hash")
    run = hashed.withColumn("_run", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    both = run.join(ahead, ["_s", "_b"]).withColumn("_from", F.col("_run") + F.col("_ahead"))
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    rest = F.floor("target") - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_from")))
    share = F.when(F.col("target") > 0, F.col("_from") / F.col("target")).otherwise(0.0)
    return both.select(
        "doc_id", "_text_hash", "source", "size", "source_size", "target", "lean", F.col("_from"),
        (whole * F.col("size") + part).cast("long").alias("taken"),
        due(share, F.col("lean")).alias("position"),
    )


def due(share, lean):
    """Training time at which a source has used `share` of its words: the root of (1 + lean) t - lean t^2 = share."""
    share = F.least(share, F.lit(1.0))
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + lean) * (1 + lean) - 4 * lean * share))
    return F.when(lean == 0, share).otherwise(2 * share / (1 + lean + root))


def expand(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixed corpus: documents' own columns, once per copy taken, range-sorted by training position.

    A copy is whole: the one that the target cuts is taken if at least half of it is due.
    """
    # Rows that repeat a document in full share one decision: their copies are counted over the group.
    keys = ["d", "t", "s"]
    own = plan.select(id_key(F.col("doc_id")).alias("d"), F.col("_text_hash").alias("t"), text_key(F.col("source")).alias("s"), "taken", "size", "_from", "source_size", "target", "lean")
    most = [F.max(c).alias(c) for c in ("size", "source_size", "target", "lean")]
    need = materialize(own.groupBy(*keys).agg(F.count("*").alias("n_"), F.sum("taken").alias("taken"), F.min("_from").alias("from"), *most).withColumn("rows", F.col("n_")), "need")
    rows = docs.select(whole_row(docs), id_key(F.col("doc_id")).alias("d"), F.xxhash64("text").alias("t"), text_key(F.col("source")).alias("s"))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("rows") / F.col("size"))).cast("int")
    both = spread_join(rows, need, keys, F.monotonically_increasing_id()).withColumn("copies", copies).where("copies > 0")
    taken = both.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    share = F.when(F.col("target") > 0, (F.col("copy") * F.col("source_size") + F.col("from")) / F.col("target")).otherwise(0.0)
    return taken.withColumn("position", due(share, F.col("lean"))).orderBy("position", "d", "t").select("row_.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and position, range-sorted by position."""
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")
