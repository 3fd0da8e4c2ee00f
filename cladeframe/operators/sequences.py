"""Sequence composition, pair distances and diversity, as Column expressions and aggregations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .reading import read_sequences


def _n(seq: Column, bases: str) -> Column:
    left = seq
    for b in bases:
        left = F.replace(left, F.lit(b), F.lit(""))
    return F.length(seq) - F.length(left)


def composition(df: DataFrame, seq: str, texts: bool = True) -> DataFrame:
    """Adds clean, length, a, c, g, t, gc_pct, ambiguous, frame and stops (best forward frame); drops under 50 bases.
    Without `texts`, the sequences and clean are dropped."""
    read = read_sequences(df.withColumn("_code", F.lit(5)), seq, "_code", 50, both=False, texts=texts)
    known = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    kept = [c for c in (*df.columns, "clean", "length", *"acgt") if texts or c not in (seq, "clean")]
    gc = F.round(100.0 * (F.col("g") + F.col("c")) / F.greatest(known, F.lit(1)), 2)
    return read.select(*kept, gc.alias("gc_pct"), (F.col("length") - known).alias("ambiguous"), (F.col("frame") - 1).alias("frame"), "stops")


def sample_per_name(df: DataFrame, keys: list[str], seq: str, rid: str, most: int) -> DataFrame:
    """The `most` longest records of each name (ties: least id): what a report on pairs is made of."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.length(seq)), rid)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def length_histogram(df: DataFrame, seq: str, width: int = 25) -> DataFrame:
    """(bin, n): sequences by length in bins of `width`; bins without any between the least and the greatest are kept."""
    n = df.groupBy(F.floor(F.length(seq) / width).alias("bin")).agg(F.count("*").alias("n"))
    every = n.agg(F.explode(F.sequence(F.min("bin"), F.max("bin"))).alias("bin"))
    return every.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def length_bars(df: DataFrame, seq: str, width: int = 25, most: int = 60) -> DataFrame:
    """(from, to, n): as length_histogram, with the width doubled until there are at most about `most` bars."""
    n = df.groupBy(F.length(seq).alias("len")).agg(F.count("*").alias("n")).where("len is not null")
    ends = n.agg((F.floor(F.min("len") / width) * width).alias("lo"), (F.floor(F.max("len") / width) * width).alias("hi"))
    doubled = F.greatest(F.lit(0), F.ceil(F.log2((F.col("hi") - F.col("lo")) / F.lit(float(width * most)))))
    ends = ends.withColumn("w", (F.pow(F.lit(2), F.coalesce(doubled, F.lit(0))) * width).cast("int"))
    ends = ends.select((F.floor(F.col("lo") / F.col("w")) * F.col("w")).alias("lo"), "hi", "w")
    every = ends.select("w", F.explode(F.sequence("lo", "hi", F.col("w").cast("long"))).alias("from"))
    counts = n.join(F.broadcast(ends)).groupBy((F.floor((F.col("len") - F.col("lo")) / F.col("w")) * F.col("w") + F.col("lo")).alias("from")).agg(F.sum("n").alias("n"))  # one row
    return every.join(counts, "from", "left").select("from", (F.col("from") + F.col("w") - 1).alias("to"), F.coalesce("n", F.lit(0)).alias("n"))


def gc3(seq: Column, frame: int) -> Column:
    """Percent of G and C among third codon positions with a known base, in a forward frame; null without any."""
    codons = F.regexp_extract_all(F.substr(seq, F.lit(frame + 1)), F.lit("..(.)"), F.lit(1))
    thirds = F.regexp_replace(F.array_join(codons, ""), "[^ACGT]", "")
    return F.round(100.0 * _n(thirds, "GC") / F.nullif(F.length(thirds), F.lit(0)), 2)


#: Rows of a block: pairs are counted between two blocks at a time, so that a group of any size is many small tasks.
BLOCK = 256


def _block_counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sites, same, transitions) of all rows of x with all rows of y; rows are bases 0 to 3 (A, C, G, T) or 4."""
    of = lambda m, *codes: np.isin(m, codes).astype(np.float32)
    same = sum(of(x, k) @ of(y, k).T for k in range(4))
    kind = of(x, 0, 2) @ of(y, 0, 2).T + of(x, 1, 3) @ of(y, 1, 3).T
    sites = of(x, 0, 1, 2, 3) @ of(y, 0, 1, 2, 3).T
    return sites.astype(np.int64), same.astype(np.int64), (kind - same).astype(np.int64)


def pair_counts(df: DataFrame, group: str, rid: str, seq: str, block: int = BLOCK) -> DataFrame:
    """(group, i, j, sites, same, ts, tv) for i < j within a group, from each pair's aligned columns.

    All pairs of a group are what is asked for. Its rows are dealt into blocks, and each pair of blocks is counted by
    products of small matrices. Rows of a null group or with a null sequence have no pairs."""
    own = df.where(F.col(group).isNotNull() & F.col(seq).isNotNull()).select(F.col(group).alias("g"), F.col(rid).alias("r"), F.upper(F.col(seq)).alias("s"))
    parts = own.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = own.join(parts, "g").withColumn("b", F.pmod(F.xxhash64("r"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("g", F.least("b", "other").alias("lo"), F.greatest("b", "other").alias("hi"), "b", "r", "s")
    names = [group, "i", "j", "sites", "same", "ts", "tv"]
    kinds = [df.schema[group].dataType.simpleString(), *[df.schema[rid].dataType.simpleString()] * 2, *["int"] * 4]
    code = np.full(256, 4, np.uint8)
    code[np.frombuffer(b"ACGT", np.uint8)] = range(4)

    def count(t: pa.Table) -> pa.Table:
        rows, at = t.column("s").to_pylist(), np.array(t.column("b").to_pylist())
        bases = np.full((len(rows), max(map(len, rows))), 4, np.uint8)
        for k, text in enumerate(rows):
            bases[k, : len(text)] = code[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
        ids, lo, hi = np.array(t.column("r").to_pylist()), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        a, b = np.flatnonzero(at == lo), np.flatnonzero(at == hi)
        sites, same, ts = _block_counts(bases[a], bases[b])
        x, y = np.nonzero(ids[a][:, None] < ids[b] if lo == hi else np.ones((len(a), len(b)), bool))
        i, j = ids[a][x], ids[b][y]
        n = [m[x, y].astype(np.int32) for m in (sites, same, ts)]
        columns = [[t.column("g")[0].as_py()] * len(x), np.minimum(i, j), np.maximum(i, j), *n, n[0] - n[1] - n[2]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, to_arrow)], names=names)

    shape = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))
    to_arrow = [f.type for f in to_arrow_schema(StructType.fromDDL(shape))]
    return dealt.groupBy("g", "lo", "hi").applyInArrow(count, shape)


def distance(model: str, least_sites: int = 100) -> Column:
    """p, JC69 or K2P from counts; null under the least sites, past saturation, or above 1."""
    n = F.nullif(F.col("sites"), F.lit(0)).cast("double")
    p, q = F.col("ts") / n, F.col("tv") / n
    if model == "p":
        d = p + q
    elif model == "jc":
        x = 1 - 4 * (p + q) / 3
        d = -0.75 * F.ln(F.when(x > 0, x))
    elif model == "k2p":
        x, y = 1 - 2 * p - q, 1 - 2 * q
        d = -0.5 * F.ln(F.when(x > 0, x)) - 0.25 * F.ln(F.when(y > 0, y))
    else:
        raise ValueError(f"unknown model: {model}")
    d = F.when(F.abs(d) < 1e-7, 0.0).otherwise(d)
    return F.when((F.col("sites") >= least_sites) & ((F.lit(model) == "p") | (d <= 1)), d)


def chao1(df: DataFrame, zone: str, unit: str) -> DataFrame:
    """(zone, n, s, f1, f2, chao1, coverage): bias-corrected richness and sample coverage by unit counts."""
    counts = df.where(F.col(unit).isNotNull()).groupBy(F.col(zone).alias("zone"), F.col(unit)).agg(F.count("*").alias("c"))
    s = counts.groupBy("zone").agg(F.sum("c").alias("n"), F.count("*").alias("s"), F.count_if(F.col("c") == 1).alias("f1"), F.count_if(F.col("c") == 2).alias("f2"))
    n, f1, f2 = F.col("n").cast("double"), F.col("f1").cast("double"), F.col("f2").cast("double")
    richness = F.col("s") + (n - 1) / n * f1 * (f1 - 1) / (2 * (f2 + 1))
    cover = F.when(f2 > 0, 1 - f1 / n * ((n - 1) * f1 / ((n - 1) * f1 + 2 * f2))).when(f1 > 0, 1 - f1 / n * ((n - 1) * (f1 - 1) / F.nullif((n - 1) * (f1 - 1) + 2, F.lit(0.0)))).otherwise(1.0)
    return s.select("*", F.round(richness, 6).alias("chao1"), F.round(cover, 6).alias("coverage"))


def chao1_interval(df: DataFrame, zone: str, unit: str, z: float = 1.96) -> DataFrame:
    """(zone, s, chao1, low, high): richness with its log-normal 95 % interval; without a variance it is s to chao1."""
    r = chao1(df, zone, unit)
    n, s, f1, f2 = (F.col(c).cast("double") for c in ("n", "s", "f1", "f2"))
    k = (n - 1) / n
    est = s + k * f1 * (f1 - 1) / (2 * (f2 + 1))
    both = k * f1 * (f1 - 1) / (2 * (f2 + 1)) + k * k * f1 * F.pow(2 * f1 - 1, 2) / (4 * F.pow(f2 + 1, 2)) + k * k * f1 * f1 * f2 * F.pow(f1 - 1, 2) / (4 * F.pow(f2 + 1, 4))
    once = k * f1 * (f1 - 1) / 2 + k * k * f1 * F.pow(2 * f1 - 1, 2) / 4 - k * k * F.pow(f1, 4) / (4 * est)
    var, t = F.when(f2 > 0, both).otherwise(once), est - s
    c = F.exp(z * F.sqrt(F.ln(1 + F.when(var > 0, var) / F.nullif(t * t, F.lit(0.0)))))
    ok = (t > 0) & (var > 0)
    return r.select("zone", "s", "chao1", F.round(F.when(ok, s + t / c).otherwise(s), 6).alias("low"), F.round(F.when(ok, s + t * c).otherwise(est), 6).alias("high"))


def beta_pairs(df: DataFrame, zone: str, unit: str) -> DataFrame:
    """(zone1, zone2, a, b, c, sorensen, simpson, nestedness): shared and own units of each pair of zones."""
    own = df.where(F.col(unit).isNotNull()).select(F.col(zone).alias("zone"), F.col(unit).alias("u")).distinct()
    sizes = own.groupBy("zone").agg(F.count("*").alias("s"))
    shared = own.alias("l").join(own.alias("r"), "u").where("l.zone < r.zone").groupBy(F.col("l.zone").alias("zone1"), F.col("r.zone").alias("zone2")).agg(F.count("*").alias("a"))
    s1, s2 = sizes.select(F.col("zone").alias("zone1"), F.col("s").alias("s1")), sizes.select(F.col("zone").alias("zone2"), F.col("s").alias("s2"))
    x = shared.join(s1, "zone1").join(s2, "zone2").withColumn("b", F.col("s1") - F.col("a")).withColumn("c", F.col("s2") - F.col("a"))
    low = F.least("b", "c")
    sor, sim = (F.col("b") + F.col("c")) / (2 * F.col("a") + F.col("b") + F.col("c")), low / (F.col("a") + low)
    return x.select("zone1", "zone2", "a", "b", "c", F.round(sor, 6).alias("sorensen"), F.round(sim, 6).alias("simpson"), F.round(sor - sim, 6).alias("nestedness"))
