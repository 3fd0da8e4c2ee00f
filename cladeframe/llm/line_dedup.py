"""Repeated lines: a suffix array over line ids, its LCP intervals, and deletion of later copies.

The corpus is its documents' lines in order of (id, text hash, line); suffixes end with their document. Suffix names are
doubled: a suffix's name for 2k lines is the rank of the pair of names for its first k lines and the k after them, by a
range sort of the distinct pairs, so names sort as the suffixes do. A suffix whose name is no longer shared lies in no
LCP interval of that depth and drops out, which leaves little after the first round.

A run of lines counts if it has MIN_WORDS words. The suffixes that share such a run from their start are one LCP
interval of that depth; names of two overlapping powers of two name the run. All but the first occurrence in corpus
order are deleted. It is enough to look at the shortest runs that start at each line and the shortest that end at each
line: any longer repeated run is the union of those within it, so what is deleted is exactly the later copies of the
maximal runs.

Cases: a null or empty text is one empty line and stays empty; a text all of whose lines go becomes empty; rows equal in
id and text are one document and all get the same lines; a null id comes first; runs do not span documents; an empty
table gives an empty result; extra columns of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize, only
from .common import id_key, n_words, spread_join, whole_row

MIN_WORDS = 50
_DOC = ["d", "t"]
_ID = ["h", "g"]


def _line_table(docs: DataFrame) -> DataFrame:
    """(d, t, i, h, g, w): document id, text hash, line number, two hashes of the line, words in the line."""
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "line")
    own = docs.select(id_key(F.col("doc_id")).alias("d"), F.xxhash64("text").alias("t"), lines)
    return own.select("d", "t", "i", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), n_words(F.col("line")).alias("w"))


def _names(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with a name that sorts as they do: place in a range sort, fixed by writing it."""
    ranged = pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    return materialize(ranged.withColumn("name", F.monotonically_increasing_id()), "names")


def _next_at_least(rows: DataFrame, at: Column, value: Column, out: Column, up: bool, of: list[str]) -> DataFrame:
    """For each row, the first `out` (in line order) whose `value` is at least `at`, or with up=False the last whose
    value is at most it: one sort per segment over points and queries together."""
    points = rows.select(*of, value.alias("v"), F.lit(0).alias("q"), F.col("i"), out.alias("o"))
    queries = rows.select(*of, at.alias("v"), F.lit(1).alias("q"), F.col("i"), F.lit(None).cast("int").alias("o"))
    w = Window.partitionBy(*of)
    # Points of equal value come before the query in scan order; of equal points the nearest in line order is taken last.
    order = [F.col("v").desc(), "q", F.col("i").desc()] if up else [F.col("v"), "q", "i"]
    seen = F.last("o", ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return points.unionByName(queries).withColumn("hit", seen).where("q = 1 and hit is not null").select(*of, "i", "hit")


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, a, n, run, first): occurrences of repeated runs: lines a to a + n - 1 of a document, the run's name, and
    whether this is its first occurrence."""
    ids = lines.groupBy(*_ID).agg(F.count("*").alias("n_")).where("n_ > 1")
    names = materialize(ids.repartitionByRange(*_ID).sortWithinPartitions(*_ID).withColumn("name", F.monotonically_increasing_id()), "names")
    at = materialize(spread_join(lines, names, _ID, F.struct(*_DOC, "i")).select(*_DOC, "i", "w", F.col("name").alias("r0")), "suffixes")
    doc = Window.partitionBy(*_DOC).orderBy("i")
    seg = at.withColumn("seg", F.col("i") - F.row_number().over(doc))  # constant along lines without a gap
    of = [*_DOC, "seg"]
    ordered = Window.partitionBy(*of).orderBy("i")
    seg = seg.withColumn("ends", F.sum("w").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("starts", F.col("ends") - F.col("w"))
    seg = materialize(seg, "segments")
    # Shortest runs of min_words from each start, and up to each end.
    ahead = _next_at_least(seg, F.col("starts") + min_words, F.col("ends"), F.col("i"), True, of).select(*of, F.col("i").alias("a"), F.col("hit").alias("z"))
    back = _next_at_least(seg, F.col("ends") - min_words, F.col("starts"), F.col("i"), False, of).select(*of, F.col("hit").alias("a"), F.col("i").alias("z"))
    runs = ahead.unionByName(back).distinct().withColumn("n", F.col("z") - F.col("a") + 1)
    runs = materialize(runs.withColumn("level", F.floor(F.log2(F.col("n") + F.lit(0.5))).cast("int")), "runs")
    longest = runs.agg(F.max("level")).first()[0]
    if longest is None:
        return runs.select("d", "t", "a", "n", F.lit(0).cast("long").alias("run"), F.lit(True).alias("first")).limit(0)

    table = seg.select(*of, "i", F.col("r0").alias("r"))
    found = []
    for level in range(longest + 1):
        step = 1 << level
        due = runs.where(F.col("level") == level)
        head = table.select(*of, F.col("i").alias("a"), F.col("r").alias("ra"))
        tail = table.select(*of, (F.col("i") + step - 1).alias("z"), F.col("r").alias("rz"))
        found.append(due.join(head, [*of, "a"]).join(tail, [*of, "z"]).select("d", "t", "a", "n", "ra", "rz"))
        if level == longest:
            break
        later = table.select(*of, (F.col("i") - step).alias("i"), F.col("r").alias("b"))
        doubled = table.join(later, [*of, "i"]).select(*of, "i", F.col("r").alias("a"), "b")
        doubled = materialize(doubled, "doubled")
        shared = doubled.groupBy("a", "b").agg(F.count("*").alias("n_")).where("n_ > 1")
        table = materialize(spread_join(doubled, _names(shared), ["a", "b"], F.struct(*of, "i")).select(*of, "i", F.col("name").alias("r")), "suffixes")
        if table.isEmpty():
            break
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = materialize(every, "occurrences")
    place = F.struct("d", "t", "a")
    run = ["n", "ra", "rz"]
    intervals = every.groupBy(*run).agg(F.count("*").alias("n_"), F.min(place).alias("least")).where("n_ > 1")
    met = spread_join(every, materialize(intervals, "intervals"), run, place)
    return met.select("d", "t", "a", "n", F.xxhash64(*run).alias("run"), (place == F.col("least")).alias("first"))


def later_copies(runs: DataFrame) -> DataFrame:
    """(d, t, a, z): the maximal runs of lines, a to z, that the later occurrences of repeated runs make up together."""
    z = F.col("a") + F.col("n") - 1
    w = Window.partitionBy(*_DOC).orderBy("a")
    reached = F.max(z).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begun = runs.where("not first").select(*_DOC, "a", "n").withColumn("new", F.coalesce(F.col("a") > reached + 1, F.lit(True)).cast("int"))
    return begun.withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*_DOC, "k").agg(F.min("a").alias("a"), F.max(z).alias("z")).drop("k")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated runs cut from `text`, plus _n_lines and _n_removed."""

    def cut() -> DataFrame:
        lines = materialize(_line_table(docs).distinct(), "lines")
        gone = later_copies(repeated_runs(lines, min_words)).select(*_DOC, F.explode(F.sequence("a", "z")).alias("i"))
        return gone.groupBy(*_DOC).agg(F.collect_set("i").alias("gone"))

    gone = only("gone", cut)
    # `gone` grows with the input: never broadcast, so that the join costs alike at every size.
    own = docs.select(whole_row(docs), id_key(F.col("doc_id")).alias("d"), F.xxhash64("text").alias("t"))
    both = own.join(gone.hint("merge"), _DOC, "left").withColumn("lines", F.split("row_.text", "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row_.text")).otherwise(F.array_join(F.transform(left, lambda k: F.get("lines", k)), "\n"))
    return both.select(
        *[(text if c == "text" else F.col("row_")[c]).alias(c) for c in docs.columns],
        F.greatest(F.size("lines"), F.lit(1)).cast("long").alias("_n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("_n_removed"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, and the text that is left."""
    own = docs.select("doc_id", "text")
    return dedup_lines(own).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")
