"""Names, BINs and lineages looked up in the whole table, and how species and BINs agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components

# Words that make a name provisional, further ones after the epithet; beginnings of countries that name none.
WORDS = ("sp", "spp", "cf", "aff", "nr", "gr", "indet")
LATER = ("x", "×", "complex")
NO_PLACE = ("unrecoverable", "unspecified", "exception", "?")


def no_place(country: Column) -> Column:
    c = F.lower(F.trim(country))
    begins = c.startswith(NO_PLACE[0])
    for p in NO_PLACE[1:]:
        begins = begins | c.startswith(p)
    return F.coalesce(begins | (country == ""), F.lit(True))


def project(processid: Column) -> Column:
    """The project's letters of a record id such as ABCDE123-24; empty for others."""
    return F.regexp_extract(F.coalesce(processid, F.lit("")), r"^([A-Z]{2,8})[0-9]+-[0-9]{2}$", 1)


def same_marker(a: Column, b: Column) -> Column:
    tidy = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return tidy(a) == tidy(b)


def species_key(name: Column) -> Column:
    """Genus and epithet of a name that settles a species; null for provisional and blank ones."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"\.+$", "")))
    loose = F.size(words) < 2
    marked = F.exists(F.slice(bare, 2, 1000), lambda w: w.isin(*WORDS, *LATER)) | F.trim(name).rlike(r"[\d?]")
    marked = marked | F.coalesce(F.get(words, 2).rlike(r"^\p{Lu}"), F.lit(False))
    return F.when(~F.coalesce(loose, F.lit(True)) & ~marked, F.concat_ws(" ", F.get(words, 0), F.get(words, 1)))


def bin_species(records: DataFrame, bins: DataFrame, bin_: str, species: str, most: int = 5) -> DataFrame:
    """(bin, total, species): of the wanted bins (column bin), how many records name a species, and the `most` commonest
    as (name, n), by count and then name."""
    named = records.where(F.col(species) != "").select(F.col(bin_).alias("bin"), F.col(species).alias("name")).join(bins.select("bin").distinct(), "bin", "left_semi")
    counts = named.groupBy("bin", "name").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("n"), "name"))
    top = F.when(F.col("k") <= most, F.struct("k", "name", "n"))
    out = counts.withColumn("k", k).groupBy("bin").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(top)).alias("l"))
    return out.select("bin", "total", F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))).alias("species"))


def name_ranks(records: DataFrame, names: DataFrame, ranks: list[str]) -> DataFrame:
    """(name, rank): the first of the ranks that holds the name; names that none holds are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(r).alias("name")) for k, r in enumerate(ranks)])).alias("x")
    held = records.select(each).select("x.*").where("name is not null").distinct().join(names.select("name").distinct(), "name")
    first = held.groupBy("name").agg(F.min("k").alias("k"))
    return first.select("name", F.element_at(F.array(*map(F.lit, ranks)), F.col("k") + 1).alias("rank"))


def lineages(records: DataFrame, names: DataFrame, ranks: list[str], unique: str) -> DataFrame:
    """(name, rank, and each rank): for names that the table knows, their rank and the commonest value (ties: the least)
    of every rank above it; the rank itself is the name. A name filed under several values of `unique` is left out."""
    known = name_ranks(records, names, ranks)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(r).alias("name")) for r in ranks])).alias("x")
    rows = records.select(each, *ranks).select("x.*", *ranks).join(known, ["name", "rank"])
    place = {r: k for k, r in enumerate(ranks)}
    at = F.element_at(F.create_map(*[F.lit(v) for kv in place.items() for v in kv]), F.col("rank"))
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("of"), F.lit(k).alias("k"), F.nullif(F.col(r), F.lit("")).alias("value")) for r, k in place.items()])).alias("c")
    counts = rows.select("name", "rank", at.alias("at"), cells).where("c.value is not null and c.k > at").groupBy("name", "rank", "c.of", "c.value").agg(F.count("*").alias("n"))
    homonyms = counts.where(F.col("of") == unique).groupBy("name").agg(F.count_distinct("value").alias("v")).where("v > 1")
    modal = counts.groupBy("name", "rank", "of").agg(F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("value"))
    wide = modal.groupBy("name", "rank").pivot("of", ranks).agg(F.max("value"))
    own = known.join(wide, ["name", "rank"], "left").join(homonyms, "name", "left_anti")
    return own.select("name", "rank", *[F.when(F.col("rank") == r, F.col("name")).otherwise(F.col(r)).alias(r) for r in ranks])


def concordance(records: DataFrame, species: str, bin_: str) -> DataFrame:
    """One row: species, bins, paired_records, species_only, bin_only, concordant_species, shared_bins, split_species.

    Species are settled names by genus and epithet; provisional ones neither count nor make a BIN shared."""
    r = records.select(F.coalesce(species, F.lit("")).alias("name"), species_key(F.col(species)).alias("s"), F.coalesce(bin_, F.lit("")).alias("b"))
    sides = r.agg(
        F.count_if((F.col("name") != "") & (F.col("b") != "")).alias("paired_records"), F.count_if((F.col("name") != "") & (F.col("b") == "")).alias("species_only"),
        F.count_if((F.col("name") == "") & (F.col("b") != "")).alias("bin_only"), F.count_distinct(F.when((F.col("name") != "") & (F.col("b") != ""), F.col("b"))).alias("bins"),
    )
    both = r.where("s is not null and b <> ''").select("s", "b").distinct()
    of_bin = both.groupBy("b").agg(F.count("*").alias("k"))
    per = both.join(of_bin, "b").groupBy("s").agg(F.count("*").alias("bins"), F.max("k").alias("k"))
    named = per.agg(F.count("*").alias("species"), F.count_if(F.expr("bins = 1 and k = 1")).alias("concordant_species"), F.count_if(F.expr("bins > 1")).alias("split_species"))
    shared = of_bin.agg(F.count_if(F.expr("k > 1")).alias("shared_bins"))
    one = sides.join(F.broadcast(named)).join(F.broadcast(shared))  # one row each
    return one.select("species", "bins", "paired_records", "species_only", "bin_only", "concordant_species", "shared_bins", "split_species")


def joined_haplotypes(reps: DataFrame, least: int = 200, k: int = 30) -> DataFrame:
    """(species, haplotypes, joined) of reps (species, clean): haplotypes that are equal over an overlap of `least` bases
    or more, the end of one being the beginning of another, count as one. Candidates meet on (species, the k bases that
    the second begins with); each is verified."""
    each = reps.select("species", "clean").distinct().withColumn("id", F.xxhash64("species", "clean")).withColumn("len", F.length("clean"))
    heads = each.where(F.col("len") >= k).select("species", F.col("id").alias("b"), F.col("clean").alias("sb"), F.col("len").alias("nb"), F.left("clean", F.lit(k)).alias("w"))
    starts = F.sequence(F.lit(2), F.col("len") - least + 1)
    offered = each.where(F.col("len") > least).select("species", F.col("id").alias("a"), F.explode(F.transform(starts, lambda p: F.struct(p.alias("p"), F.substr("clean", p, F.lit(k)).alias("w")))).alias("x")).select("species", "a", "x.*")
    offered = offered.join(heads.select("species", "w").distinct(), ["species", "w"], "left_semi")
    met = offered.join(heads, ["species", "w"]).where("a <> b").join(each.select("species", F.col("id").alias("a"), F.col("clean").alias("sa"), F.col("len").alias("na")), ["species", "a"])
    over = F.col("na") - F.col("p") + 1
    edges = met.where((over < F.col("nb")) & (F.substr("sa", F.col("p")) == F.left("sb", over))).select("a", "b").distinct()
    groups = components(each.select(F.col("id").alias("node")), edges)
    named = each.join(groups, F.col("id") == F.col("node"))
    return named.groupBy("species").agg(F.count("*").alias("haplotypes"), F.count_distinct("label").alias("joined"))
