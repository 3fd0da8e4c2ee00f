"""Taxonomic distinctness with missing ranks filled in, and what random sets of taxa would show.

Delta+ is the mean, and Lambda+ the variance, of the taxonomic distances of pairs of taxa; the greatest distance is 100
and each rank that a pair shares brings it a step nearer. Pairs are never made: those that share a rank are n (n - 1) / 2
of its n members. `ranks` go up from the taxa's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize

DRAWS, SEED = 500, 1


def lineages(df: DataFrame, ranks: list[str]) -> DataFrame:
    """One row a taxon that has a value for the first two ranks, with all ranks: the least of its values, then, rank by
    rank, a missing one (null or empty) taken from the commonest value (ties: the least) that others of its rank below
    have; where these have none, one of its own, which is the value below after a question mark."""
    said = [F.when(F.col(f"`{r}`") != "", F.col(f"`{r}`")).alias(r) for r in ranks]
    taxa = df.select(*said).where(F.col(f"`{ranks[0]}`").isNotNull()).groupBy(ranks[0]).agg(*[F.min(r).alias(r) for r in ranks[1:]])
    taxa = materialize(taxa.where(F.col(ranks[1]).isNotNull()), "taxa")
    for low, high in zip(ranks[1:], ranks[2:]):
        known = taxa.where(F.col(high).isNotNull()).groupBy(low, high).agg(F.count("*").alias("n_"))
        common = known.groupBy(low).agg(F.min(F.struct(-F.col("n_"), high))[high].alias("common_"))
        filled = F.coalesce(high, "common_", F.concat(F.lit("?"), low))
        taxa = taxa.join(common, low, "left").select(*[filled.alias(r) if r == high else F.col(r) for r in ranks])
    return materialize(taxa, "lineages")


def telling(taxa: DataFrame, ranks: list[str]) -> list[str]:
    """The ranks above the first of which not all taxa share one value: others say nothing, and take no step."""
    if len(ranks) < 2:
        return []
    kinds = taxa.agg(*[F.count_distinct(r).alias(r) for r in ranks[1:]]).first()
    return [r for r in ranks[1:] if kinds[r] > 1]


def measures(members: DataFrame, by: list[str], ranks: list[str]) -> DataFrame:
    """(*by, taxa, delta_plus, lambda_plus) of members (*by and the ranks above the taxa's own); null for a single taxon."""
    out = members.groupBy(*by).agg(F.count("*").alias("taxa"))
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    for k, r in enumerate(ranks):
        sizes = members.groupBy(*by, r).agg(F.count("*").alias("n_")).groupBy(*by).agg(F.sum(pairs("n_")).alias(f"s{k}_"))
        out = out.join(sizes, by)
    # Pairs that share a rank share those above: where taxonomies contradict that, the count above is raised.
    shared: list[Column] = []
    for k in range(len(ranks)):
        shared.append(F.greatest(shared[-1], f"s{k}_") if shared else F.col("s0_"))
    total = pairs("taxa")
    counts = [b - a for a, b in zip([F.lit(0.0), *shared], [*shared, total])]
    weight = [100.0 * (k + 1) / len(counts) for k in range(len(counts))]
    mean = sum((n * w for n, w in zip(counts, weight)), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    out = out.withColumn("d_", mean)
    spread = sum((n * (F.lit(w) - F.col("d_")) * (F.lit(w) - F.col("d_")) for n, w in zip(counts, weight)), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    return out.select(*by, "taxa", F.col("d_").alias("delta_plus"), spread.alias("lambda_plus"))


def zone_distinctness(df: DataFrame, zone: str, ranks: list[str]) -> DataFrame:
    """(zone, taxa, delta_plus, lambda_plus) of each zone's taxa, by lineages filled over all zones."""
    taxa = lineages(df, ranks)
    own = df.where(F.col(f"`{zone}`").isNotNull()).select(F.col(f"`{zone}`").alias("zone"), F.col(f"`{ranks[0]}`")).distinct()
    return measures(own.join(taxa, ranks[0]), ["zone"], telling(taxa, ranks))


def random_sets(taxa: DataFrame, ranks: list[str], sizes: list[int], draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(size, mean, low, high, l_mean, l_low, l_high): Delta+ and Lambda+ of `draws` random sets of each size, without
    replacement: their means and the bounds of the middle 95 %.

    A draw orders all taxa by the md5 of seed, draw and taxon; its sets of all sizes are the first so many. Draws are
    dealt over tasks, a draw's taxa are ordered in one. Sizes over the number of taxa are all taxa."""
    own = telling(taxa, ranks)
    each = taxa.select(*ranks).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("draw").cast("string"), F.col(ranks[0])))
    placed = each.withColumn("place", F.row_number().over(Window.partitionBy("draw").orderBy(key, ranks[0])))
    sets = placed.withColumn("size", F.explode(F.filter(F.array(*[F.lit(s) for s in sorted(set(sizes))]), lambda s: s >= F.col("place"))))
    told = measures(sets.select("draw", "size", *own), ["draw", "size"], own)
    bound = lambda c, p: F.percentile(c, F.lit(p))
    return told.groupBy("size").agg(
        F.avg("delta_plus").alias("mean"), bound("delta_plus", 0.025).alias("low"), bound("delta_plus", 0.975).alias("high"),
        F.avg("lambda_plus").alias("l_mean"), bound("lambda_plus", 0.025).alias("l_low"), bound("lambda_plus", 0.975).alias("l_high"),
    )
