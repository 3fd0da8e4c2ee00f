"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, ORDER of them: with words, most words of clean text are unknown here, and an unknown word
says nothing about how it is spelled. Trusted texts are those labelled good and not toxic. All of them are used, at any
number: the half with the least hashes of their ids trains the model, and the other half, which the model has not seen, sets
the thresholds. N-grams are counted by Spark, sharded by n-gram; lower orders, discounts and context totals are aggregates of
these tables.

Every document is scored over its whole text. The distinct n-grams of all documents, each once, are joined with the
counts of every order, which gives each its log probability. Those that make up at least HOT of all positions, at most
1 / HOT of them, are looked up where the documents are read; a document's other n-grams are joined by shuffle, where
none is hot by definition.

A document goes if its perplexity, drawn towards its language's mean as if PRIOR more characters had been seen, is above
the language's QUANTILE among the trusted documents that did not train it. A language with fewer than LEAST_KNOWN of those
uses the quantile over all.

Cases: a null or empty text is scored on its end alone; a null language is a language of its own; repeated rows get one
row each; without trusted documents, or with none besides those that train, nothing is rejected; repeated labels count once;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import discard, materialize

QUANTILE = 0.995
PRIOR = 100
LEAST_KNOWN = 30
ORDER = 5
HOT = 1e-6
#: A key is the classes of an n-gram's characters, BITS each, the oldest first.
BITS = 12
_START, _UNKNOWN, _END, _UPPER, _DIGIT, _FIRST = range(6)
_HELD = 2_000_000


def code_table(kept: str) -> np.ndarray:
    """Class of each code point: its own for the kept characters, one each for other capitals and digits, or unknown."""
    table = np.full(0x110000, _UNKNOWN, np.int64)
    for cp in range(0x500):
        table[cp] = _UPPER if chr(cp).isupper() else _DIGIT if chr(cp).isdigit() else _UNKNOWN
    for k, c in enumerate(kept[: (1 << BITS) - _FIRST]):
        table[ord(c)] = _FIRST + k
    return table


def gram_keys(table: np.ndarray, text: str | None, order: int = ORDER) -> np.ndarray:
    """The key of every character's n-gram, the end's included."""
    codes = table[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")]
    codes = np.concatenate([[_START] * (order - 1), codes, [_END]])
    key = codes[: len(codes) - order + 1]
    for k in range(1, order):
        key = (key << BITS) | codes[k : len(codes) - order + 1 + k]
    return key


def gram_counts(docs: DataFrame, kept: str, order: int = ORDER) -> DataFrame:
    """(key, c): how often each n-gram occurs in the column text; partial counts leave a task when its table is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys, counts, held = code_table(kept), [], [], 0

        def merged():
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)

        for b in batches:
            for t in b.column(0):
                k, c = np.unique(gram_keys(table, t.as_py(), order), return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > _HELD:
                    k, c = merged()
                    keys, counts, held = [k], [c], len(k)
                    if held > _HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["key", "c"])
                        keys, counts, held = [], [], 0
        if held:
            k, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["key", "c"])

    return docs.select("text").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def last(key: Column, k: int) -> Column:
    """The n-gram of an n-gram's last k characters."""
    return key.bitwiseAND(F.lit((1 << BITS * k) - 1))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D for counts 1, 2 and 3 or more, from how many n-grams have each count (Chen and Goodman, 1998)."""
    n1, n2, n3, n4 = (max(n, 1) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(x, low), high) for x, low, high in zip(d, (0.1, 0.2, 0.3), (0.95, 1.9, 2.85))]


def model_tables(counts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """Per order, from 1: (key, c, d), its n-grams with count and discount, and (head, total, rest), its contexts with
    the sum of counts and of discounts. Orders below the highest count distinct left neighbours."""
    out = []
    for k in range(order, 0, -1):
        counts = materialize(counts, f"order{k}")
        d1, d2, d3 = discounts(*counts.agg(*[F.count_if(F.col("c") == n) for n in (1, 2, 3, 4)]).first())
        grams = counts.withColumn("d", F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3))
        heads = grams.groupBy(F.shiftright("key", BITS).alias("head")).agg(F.sum("c").alias("total"), F.sum("d").alias("rest"))
        out.append((grams, heads))
        counts = counts.groupBy(last(F.col("key"), k - 1).alias("key")).agg(F.count("*").alias("c"))
    return out[::-1]


def gram_nats(grams: DataFrame, tables: list[tuple[DataFrame, DataFrame]], classes: int) -> DataFrame:
    """(key, nats) of distinct n-grams: each order's counts are joined with the distinct endings of that length."""
    p = None
    for k, (own, heads) in enumerate(tables, 1):
        met = grams.select(last(F.col("key"), k).alias("key")).distinct().withColumn("head", F.shiftright("key", BITS))
        # By shuffle at every size: as broadcasts, ten tables at once would be built in the driver's memory.
        met = met.join(own.hint("merge"), "key", "left").join(heads.hint("merge"), "head", "left")
        if p is None:
            met = met.withColumn("p0", F.lit(1 / classes))
        else:
            met = met.withColumn("end", last(F.col("key"), k - 1)).join(p.select(F.col("key").alias("end"), F.col("p").alias("p0")).hint("merge"), "end")
        seen = (F.coalesce(F.col("c") - F.col("d"), F.lit(0.0)) + F.col("rest") * F.col("p0")) / F.col("total")
        # Written order by order: all joins as one plan would be planned anew in the driver after each of its shuffles.
        p = materialize(met.select("key", F.coalesce(seen, F.col("p0")).alias("p")), f"nats{k}")
    return p.select("key", (-F.log("p")).alias("nats"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, h) of trusted documents: labelled good by every label, and toxic by none."""
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return own.where("q = 1 and t = 0").select("doc_id", F.xxhash64("doc_id").alias("h"))


def median_hash(trusted: DataFrame) -> int | None:
    """The greatest hash of the lower half (of an odd number, one more) of the trusted; null without any. Exact: hashes are
    counted by their leading bits, and only those of the bucket that holds the middle are ordered."""
    rank = -(-trusted.count() // 2)
    if not rank:
        return None
    bucket = F.shiftright("h", 48)
    before = 0
    for row in trusted.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).orderBy("b").toLocalIterator():  # 65,536 at most
        if before + row["n"] >= rank:
            break
        before += row["n"]
    return trusted.where(bucket == row["b"]).orderBy("h").offset(rank - before - 1).first()["h"]


def may_be_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs without most of those whose doc_id is not among ids, so that their texts need not be shuffled: a table
    of 65,536 rows of 64 bits at most, whatever the number of ids, tells which may be; it lets too many through at worst."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 22))
    at = [F.shiftright(place, 6).alias("w_"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id, 1), 64) as int))").alias("bit_")]
    table = ids.select(*at).groupBy("w_").agg(F.bit_or("bit_").alias("bits_"))
    return docs.select("*", *at).join(F.broadcast(table), "w_").where(F.col("bit_").bitwiseAND(F.col("bits_")) != 0).drop("w_", "bit_", "bits_")


def train(docs: DataFrame, trusted: DataFrame) -> tuple[tuple | None, int | None]:
    """(kept characters, tables by order) of the half of the trusted documents with the least hashes, and the greatest hash
    among these."""
    greatest = median_hash(trusted)
    if greatest is None:
        return None, None
    ids = trusted.where(F.col("h") <= greatest).select("doc_id")
    # Not a semi-join: Spark would move that below may_be_among, and shuffle every text. The ids are distinct.
    texts = may_be_among(docs.select(F.col("doc_id").cast("long"), "text"), ids).join(ids.hint("merge"), "doc_id")
    texts = materialize(texts.select("text"), "trusted")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(t or "")
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["ch", "c"])

    common = texts.mapInArrow(count, "ch string, c long").groupBy("ch").agg(F.sum("c").alias("c"))
    common = common.where(~F.col("ch").rlike(r"^[\p{Lu}\p{Nd}]$")).orderBy(F.desc("c"), "ch").limit((1 << BITS) - _FIRST).collect()
    kept = "".join(r["ch"] for r in common)
    tables = model_tables(gram_counts(texts, kept))
    discard(texts)  # the tables are files of their own
    return (kept, tables), greatest


def perplexities(docs: DataFrame, model: tuple) -> DataFrame:
    """Per row: doc_id, text_hash, lang, n_tokens (characters and the end), nats (total)."""
    kept, tables = model
    counts = materialize(gram_counts(docs, kept), "grams")
    limit = max(2.0, HOT * (counts.agg(F.sum("c")).first()[0] or 0))
    nats = materialize(gram_nats(counts, tables, _FIRST + len(kept)).join(counts.hint("merge"), "key"), "gram_nats")
    # At most 1 / HOT rows: those with that share of all positions.
    hot = nats.where(F.col("c") >= limit).select("key", "nats").toPandas().sort_values("key")
    shared = docs.sparkSession.sparkContext.broadcast((hot["key"].to_numpy(np.int64), hot["nats"].to_numpy(np.float64)))
    rare = pa.list_(pa.struct([("key", pa.int64()), ("c", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (known, value) = code_table(kept), shared.value
        uid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                n, total, keys, times, places = [], [], [], [], [0]
                for t in b.column(3):  # one text's keys at a time: they take eight times its room
                    key, c = np.unique(gram_keys(table, t.as_py()), return_counts=True)
                    at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
                    hit = known[at] == key if len(known) else np.zeros(len(key), bool)
                    n.append(int(c.sum()))
                    total.append(float(value[at[hit]] @ c[hit]))
                    keys.append(key[~hit])
                    times.append(c[~hit])
                    places.append(places[-1] + len(keys[-1]))
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(times))], names=["key", "c"])
                other = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pairs)
                ids = pa.array(np.arange(uid, uid + b.num_rows))
                uid += b.num_rows
                yield pa.RecordBatch.from_arrays([ids, *b.columns[:3], pa.array(n, pa.int64()), pa.array(total, pa.float64()), other.cast(rare)], names=["uid", "doc_id", "text_hash", "lang", "n_tokens", "nats", "rare"])

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("lang").cast("string"), "text")
    read = materialize(own.mapInArrow(run, "uid long, doc_id long, text_hash long, lang string, n_tokens long, nats double, rare array<struct<key:long,c:long>>"), "scored")
    each = read.select("uid", F.explode("rare").alias("x")).select("uid", "x.key", "x.c")
    own = nats.where(F.col("c") < limit).select("key", "nats")
    more = each.join(own.hint("merge"), "key").groupBy("uid").agg(F.sum(F.col("c") * F.col("nats")).alias("more"))
    both = read.drop("rare").join(more.hint("merge"), "uid", "left")
    # Rounded, since a sum's last digits hang on its order.
    return both.select("doc_id", "text_hash", "lang", "n_tokens", F.round(F.col("nats") + F.coalesce("more", F.lit(0.0)), 6).alias("nats"))


def quality_filter(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Per row: doc_id, text_hash, lang, n_tokens, perplexity, threshold, kept."""
    trusted = materialize(trusted_ids(labels), "trusted_ids")
    model, greatest = train(docs, trusted)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("lang").cast("string"), F.lit(None).cast("long").alias("n_tokens"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    scored = materialize(perplexities(docs, model), "perplexities")
    fresh = scored.join(trusted.where(F.col("h") > greatest).select("doc_id").hint("merge"), "doc_id", "left_semi")
    rate = F.col("nats") / F.col("n_tokens")
    # Rounded, since a sum's last digits hang on its order, and written once for all uses: reruns agree.
    mean = F.round(F.avg(rate), 9)
    means = fresh.groupBy("lang").agg(mean.alias("mean"), F.count("*").alias("n")).where(F.col("n") >= LEAST_KNOWN).select("lang", "mean")
    means, overall = materialize(means, "means"), fresh.agg(mean).first()[0]

    def drawn(df: DataFrame) -> DataFrame:
        l, r = df.alias("l"), means.alias("r")
        both = l.join(r, F.col("l.lang").eqNullSafe(F.col("r.lang")), "left").select("l.*", F.coalesce("mean", F.lit(overall)).alias("mean"))
        return both.withColumn("level", (F.col("nats") + PRIOR * F.col("mean")) / (F.col("n_tokens") + PRIOR)).drop("mean")

    known = materialize(drawn(fresh), "known")
    limits = known.groupBy("lang").agg(F.percentile_approx("level", quantile, 10000).alias("limit"), F.count("*").alias("n")).where(F.col("n") >= LEAST_KNOWN).select("lang", "limit")
    fallback = known.agg(F.percentile_approx("level", quantile, 10000)).first()[0]
    l, r = drawn(scored).alias("l"), limits.alias("r")
    both = l.join(r, F.col("l.lang").eqNullSafe(F.col("r.lang")), "left").select("l.*", F.coalesce("limit", F.lit(fallback).cast("double")).alias("limit"))
    return both.select("doc_id", "text_hash", "lang", "n_tokens", F.exp("level").alias("perplexity"), F.exp("limit").alias("threshold"), F.coalesce(F.col("level") <= F.col("limit"), F.lit(True)).alias("kept"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_filter(docs, labels).select("doc_id", "lang", "n_tokens", "perplexity", "threshold", "kept")
