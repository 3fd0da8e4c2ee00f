"""SimHash near-duplicates: fingerprints linked where few bits differ, and the connected groups.

Pigeonhole blocks: the 64 bits are cut into 4 blocks; of two fingerprints that differ in at most 2 bits, at least 2
blocks agree, so they meet under one of the 6 pairs of blocks, 32 bits each. Equal fingerprints are first made one.
A block bucket with more than PAIRS_UP_TO members is not paired (that would grow with its square): its members emit
themselves and their 64 one-bit neighbours instead. Two fingerprints are within 2 bits of each other exactly if they
share such a point, so the members of a point link to its least one and no link is lost.

Cases: a null or empty text has fingerprint zero and is linked like any other; fewer words than a shingle are one
shingle; repeated rows are returned once per row; rows with a null id take part and get their group's id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import spread_join
from .components import connected

PAIRS_UP_TO = 48


def bit_counts(hashes):
    """How many of the unsigned 64-bit hashes have each bit set, the highest first."""
    import numpy as np

    return np.unpackbits(np.asarray(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def block_keys(fp: int) -> list[int]:
    """The six pairs of blocks of an unsigned fingerprint, each with its number before it."""
    block = [fp >> 16 * k & 0xFFFF for k in range(4)]
    return [n << 32 | block[i] << 16 | block[j] for n, (i, j) in enumerate(combinations(range(4), 2))]


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint as an unsigned number: a bit is set if it is set in over half of the shingles' hashes."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):  # bounded memory for a text of any length
        some = [digest(line[a:b], 42) for a, b in zip(starts[lo : min(n, lo + (1 << 16))], ends[lo + shingle - 1 :])]
        ones += bit_counts(some)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint_of(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x - (1 << 64) if x >> 63 else x for x in found], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column fp of at most 2 differing bits, enough to keep every
    group connected."""
    blocks = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    keys = [
        F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(blocks[i].cast("long"), 16)).bitwiseOR(blocks[j].cast("long"))
        for n, (i, j) in enumerate(combinations(range(4), 2))
    ]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("n_", F.col("n")), "blocks")
    shared = materialize(spread_join(keyed, sizes, ["key"], F.col("fp")), "blocked")
    small = shared.where(F.col("n") <= PAIRS_UP_TO)
    a, b = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    crowded = shared.where(F.col("n") > PAIRS_UP_TO).select("fp").distinct()
    bits = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)])
    points = crowded.select("fp", F.explode(bits).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("point", "a")
    stars = points.join(least, "point").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links reach, the document's own included."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "groups")
    labels = connected(links(groups.select("fp"))).withColumnRenamed("node", "fp")
    tied = materialize(groups.join(labels.hint("merge"), "fp", "left").select("fp", "least", "rows", F.coalesce("label", "fp").alias("label")), "tied")
    roots = materialize(tied.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n_")), "roots")
    named = spread_join(tied, roots, ["label"], F.col("fp")).select("fp", "component_id", F.col("rows").alias("n_"))
    return spread_join(prints, materialize(named, "named"), ["fp"], F.col("doc_id")).select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
