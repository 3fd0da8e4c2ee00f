"""Pivot reports, term matching, value lists and snapshot differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from ..functions.text import fold
from ..plans.materialize import materialize


def pivot_cells(df: DataFrame, row: str, col: str, measure: Column, top: int | None = 15) -> DataFrame:
    """(row_label, col_label, is_row_total, is_col_total, value): one cube gives cells and exact totals.

    Columns beyond the `top` most frequent are one column, Other, unless that is None; labels are folded values.
    """
    def keyed(name: str) -> Column:
        return fold(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("(none)")))

    frame = df.withColumn("_r", keyed(row)).withColumn("_c", keyed(col))
    if top is None:
        return _cells(frame, measure)
    most = frame.groupBy("_c").count().orderBy(F.desc("count"), "_c").limit(top).select("_c")  # `top` rows
    folded = frame.join(F.broadcast(most.withColumn("_in", F.lit(True))), "_c", "left").withColumn("_c", F.when(F.col("_in"), F.col("_c")).otherwise("Other"))
    return _cells(folded, measure)


def _cells(frame: DataFrame, measure: Column) -> DataFrame:
    cells = frame.cube("_r", "_c").agg(measure.alias("value"), F.grouping("_r").alias("gr"), F.grouping("_c").alias("gc"))
    return cells.select(F.col("_r").alias("row_label"), F.col("_c").alias("col_label"), (F.col("gc") == 1).alias("is_row_total"), (F.col("gr") == 1).alias("is_col_total"), "value")


#: Most rows and columns of a pivot on a screen.
ROWS, COLUMNS = 300, 15


def pivot_table(df: DataFrame, row: str, col: str, measure: Column, full: bool = False) -> DataFrame:
    """(row_label, row_total, col_label, col_total, value): the cells of a pivot's ROWS rows of greatest total (ties: by
    label) and COLUMNS columns, the others under Other; `full` keeps all rows and columns. Totals are exact, over all
    records of the row or column."""
    cells = materialize(pivot_cells(df, row, col, measure, None if full else COLUMNS), "pivot")
    rows = cells.where("is_row_total and not is_col_total").select("row_label", F.col("value").alias("row_total"))
    if not full:
        rows = rows.orderBy(F.desc("row_total"), "row_label").limit(ROWS)
    cols = cells.where("is_col_total and not is_row_total").select("col_label", F.col("value").alias("col_total"))
    inner = cells.where("not is_row_total and not is_col_total").select("row_label", "col_label", "value")
    return inner.join(rows, "row_label").join(cols, "col_label").select("row_label", "row_total", "col_label", "col_total", "value")


def term_counts(matches: DataFrame, rid: str) -> DataFrame:
    return matches.groupBy("term").agg(F.count_distinct(rid).alias("records"))


def value_lists(df: DataFrame, key: str, value: str, most: int = 3) -> DataFrame:
    """(key, n_values, top_values): values by frequency, then name, the first `most` listed with counts."""
    counts = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(F.col(key).alias("key"), fold(F.col(value)).alias("_k")).agg(F.count("*").alias("n"), F.min(value).alias("label"))
    w = Window.partitionBy("key").orderBy(F.desc("n"), "label")
    ranked = counts.withColumn("_rank", F.row_number().over(w))
    said = F.when(F.col("_rank") <= most, F.struct("_rank", F.concat("label", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("s")))
    return ranked.groupBy("key").agg(F.count("*").alias("n_values"), F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["s"]), "; ").alias("top_values"))


#: Rows of both snapshots that are compared in one pass: what a pass shuffles is bounded by them.
PASS_ROWS = 1 << 25


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], old_id: str, new_id: str) -> DataFrame:
    """(op, old_id, new_id) with op same, chg, new or gone.

    Copies are numbered within (key, hash): equal numbers are the same row. What is left is paired by number within the
    key."""
    passes = diff_passes(old, new, key, old_id, new_id)
    if len(passes) > 1:
        passes = [materialize(p, "diff") for p in passes]
    return reduce(DataFrame.unionByName, passes)


def diff_passes(old: DataFrame, new: DataFrame, key: list[str], old_id: str, new_id: str, carried: list[str] | None = None) -> list[DataFrame]:
    """What snapshot_diff gives, in parts of whole keys with about PASS_ROWS rows of the snapshots each, with the columns
    `carried` of the new row, or of the old one where op is same or gone. Both snapshots are laid together, so that one
    exchange by key serves all steps; written part by part, the parts' shuffle files do not add up."""
    plain = lambda c: {df.schema[c].dataType for df in (old, new)} in ({IntegerType()}, {LongType()})
    keys = [f"_key{k}" for k in range(len(key))]
    told = [(F.col(c) if plain(c) else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(k) for c, k in zip(key, keys)]
    side = lambda df, i, s: df.select(*told, F.col("h").alias("_h"), F.col(i).alias("_id"), F.lit(s).alias("_side"), *(carried or []))
    rows = side(old, old_id, 0).unionByName(side(new, new_id, 1))
    passes = max(1, -(-rows.count() // PASS_ROWS))
    of = F.pmod(F.xxhash64(*keys), F.lit(passes))
    return [_differences(rows if passes == 1 else rows.where(of == k), keys, carried or []) for k in range(passes)]


def _differences(rows: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    def number(*of: str) -> Column:
        return F.row_number().over(Window.partitionBy(*keys, *of, "_side").orderBy("_id"))

    def other(*of: str) -> Column:
        """The id of the other side's row of this number."""
        both = Window.partitionBy(*keys, *of).orderBy("_side")
        return F.coalesce(F.lead("_id").over(both), F.lag("_id").over(both))

    rows = rows.repartition(*keys).withColumn("_k", number("_h")).withColumn("_same", other("_h", "_k"))
    rows = rows.withColumn("_met", F.col("_same").isNotNull()).where("not _met or _side = 0")
    rows = rows.withColumn("_j", number("_met")).withColumn("_mate", other("_met", "_j")).where("_met or _mate is null or _side = 1")
    op = F.when(F.col("_met"), "same").when(F.col("_mate").isNotNull(), "chg").when(F.col("_side") == 0, "gone").otherwise("new")
    old = F.when(F.col("_side") == 0, F.col("_id")).otherwise(F.col("_mate"))
    new = F.when(F.col("_met"), F.col("_same")).when(F.col("_side") == 1, F.col("_id"))
    return rows.select(op.alias("op"), old.alias("old_id"), new.alias("new_id"), *carried)


def change_rate(diff: DataFrame, most: float = 0.10) -> DataFrame:
    """(n_old, changed, refused): an update that changes over `most` of the old rows is refused."""
    s = diff.agg(F.count("old_id").alias("n_old"), F.count_if(F.col("op") != "same").alias("changed"))
    return s.withColumn("refused", F.col("changed") > most * F.greatest("n_old", F.lit(1)))


def second_field(matches: DataFrame, df: DataFrame, column: str, values: DataFrame, rid: str) -> DataFrame:
    """matches whose record's `column` is one of values (value2), with that value."""
    keys = values.select("value2", fold(F.col("value2")).alias("_k"))
    of = df.select(rid, fold(F.col(column)).alias("_k")).join(keys, "_k").drop("_k")
    return matches.join(of, rid)


def combinations_not_found(terms: DataFrame, values: list[str], found: DataFrame) -> DataFrame:
    """(term, value2) that no record has; values are a request's short list."""
    every = terms.select("term", F.explode(F.array(*[F.lit(v) for v in values])).alias("value2"))
    return every.join(found.select("term", "value2").distinct(), ["term", "value2"], "left_anti")
