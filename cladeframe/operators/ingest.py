"""From raw lines to a stored table: cleaning with counts, fingerprints, published versions, snapshot updates."""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.names import normalize_text
from ..functions.text import null_if_blank
from ..plans.materialize import create_once, materialize
from .dictionary import changed_counts, open_dictionary, store_dictionary, stored_counts, value_counts
from .reports import change_rate, diff_passes, snapshot_diff


def classify_lines(lines: DataFrame, places: dict[str, int], sequence: str, line: str = "value") -> DataFrame:
    """lines plus `fate` and the fields: fate is kept, no_seq, only_n, malformed (too short to hold the sequence) or blank.

    Fields are trimmed; those of a line with any non-ASCII character are normalised; the empty text and None are null; a
    sequence loses gaps and is upper case."""
    told = list(places)
    shape = StructType(lines.schema.fields + StructType.fromDDL("fate string, _odd boolean").fields + [StructField(f"_raw_{n}", StringType()) for n in told])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_fields(x, places, sequence) for x in b.column(b.schema.names.index(line)).to_pylist()]
            made = [pa.array([f[k] for f in found], pa.bool_() if k == 1 else pa.string()) for k in range(len(told) + 2)]
            yield pa.RecordBatch.from_arrays(b.columns + made, names=shape.names)

    parts = lines.mapInArrow(run, shape)
    # The rules of odd lines stand once, in a function over an array: written out for each field they outgrow what Spark compiles.
    parts = parts.withColumn("_told", F.when(F.col("_odd"), F.transform(F.array(*[F.col(f"_raw_{n}") for n in told]), normalize_text)))
    own = lambda k, n: F.col(f"_raw_{n}") if n == sequence else F.when(F.col("_odd"), null_if_blank(F.get("_told", F.lit(k)))).otherwise(F.col(f"_raw_{n}"))
    return parts.select(*lines.columns, "fate", *[own(k, n).alias(n) for k, n in enumerate(told)])


_SPACES = " \t\n\x0b\x0c\r" + "".join(chr(x) for x in range(0x80, 0x3001) if unicodedata.category(chr(x)).startswith("Z"))


def _fields(line: str | None, places: dict[str, int], sequence: str) -> list:
    """(fate, whether it has a non-ASCII character, each field; the sequence without gaps and in upper case) of one line."""
    parts = (line or "").split("\t") if line is not None else []
    raw = {n: parts[k].strip(_SPACES) if k < len(parts) else None for n, k in places.items()}
    odd = line is not None and not line.isascii()
    kept = {n: x if odd or x not in ("", "None") else None for n, x in raw.items()}  # an odd field is judged once it is normalised
    seq = None if raw[sequence] in (None, "", "None") else raw[sequence].replace("-", "").upper()
    kept[sequence] = seq
    if line is not None and not line.strip(" "):
        fate = "blank"
    elif line is not None and len(parts) <= places[sequence]:
        fate = "malformed"
    else:
        fate = "no_seq" if not seq else "only_n" if not seq.strip("N") else "kept"
    return [fate, odd, *kept.values()]


def ingest_counts(classified: DataFrame) -> DataFrame:
    """(fate, lines): one pass, combined before the shuffle."""
    return classified.groupBy("fate").agg(F.count("*").alias("lines"))


def row_hash(columns: list[str]) -> Column:
    """Digest of a row's values by column name; null and empty text are alike."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in sorted(columns)]), 256)


def numbered(df: DataFrame, by: list[str], name: str, start: int = 0, keep: list[str] | None = None) -> DataFrame:
    """Adds start + 1, start + 2, ... in the order of `by`, without a task that sees all rows: a range sort, the sizes of
    its partitions (one row each), and each row's place in its own. Of the columns only `keep` go on, if given."""
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id()  # partition in the upper bits, row within it in the lower 33
    held = materialize(ranged.select(*(keep or df.columns), place.alias("_at")), "ranged").withColumn("_p", F.shiftright("_at", 33))
    before = F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.groupBy("_p").agg(F.count("*").alias("n")).select("_p", F.coalesce(before, F.lit(0)).alias("_o"))
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + row + 1 + start).drop("_p", "_at", "_o")


def snapshot_apply(old: DataFrame, new: DataFrame, diff: DataFrame, rid: str, line: str) -> DataFrame:
    """The next version: unchanged rows and their ids, changed rows under their old ids, new rows with ids after the
    greatest; rows that are gone are left out. `diff` is what snapshot_diff gave for the same tables."""
    columns = [c for c in new.columns if c != line]
    kept = old.join(diff.where("op = 'same'").select(F.col("old_id").alias(rid)), rid, "left_semi").select(rid, *columns)
    changed = new.join(diff.where("op = 'chg'").select(F.col("new_id").alias(line), F.col("old_id").alias(rid)), line).select(rid, *columns)
    added = new.join(diff.where("op = 'new'").select(F.col("new_id").alias(line)), line, "left_semi")
    top = old.agg(F.max(rid)).first()[0] or 0
    return kept.unionByName(changed).unionByName(numbered(added, [line], rid, top).select(rid, *columns))


def next_snapshot(old: DataFrame, new: DataFrame, key: list[str], rid: str, line: str, columns: list[str]) -> DataFrame:
    """What snapshot_apply gives of (rid, columns), with the difference taken here: it carries the columns, so that rows are
    not joined with it again. Rows need `h` for the comparison; what it can be worked out from may be carried in its place."""
    parts = [materialize(p, "diff") for p in diff_passes(old, new, key, rid, line, columns)]
    diff = reduce(DataFrame.unionByName, parts)
    kept = diff.where("op in ('same', 'chg')").select(F.col("old_id").alias(rid), *columns)
    added = diff.where("op = 'new'").select(F.col("new_id").alias(line), *columns)
    top = old.agg(F.max(rid)).first()[0] or 0
    return kept.unionByName(numbered(added, [line], rid, top).select(rid, *columns))


class Refused(ValueError):
    """An update that must not be published; nothing was changed."""


def table_digest(df: DataFrame, h: str = "h") -> tuple[int, int]:
    """(rows, sum of their hashes): equal for tables with the same rows in any order, copies counted."""
    part = F.conv(F.substr(F.sha2(F.col(h), 256), F.lit(1), F.lit(15)), 16, 10).cast("decimal(38,0)")
    rows, total = df.agg(F.count("*"), F.sum(part)).first()
    return rows, int(total or 0)


class Conflict(RuntimeError):
    """Another writer published the version that this one was to be; nothing was changed."""


def update(
    new: DataFrame, root: str, key: list[str], rid: str = "id", most: float = 0.10, force: bool = False, values: list[str] | None = None, tries: int = 5,
) -> tuple[int, dict[str, int]]:
    """Brings the table under root to the rows of `new`, as a new version: (its number, rows by what became of them).

    Unchanged and changed rows keep their ids. Without a version yet, all rows are new. Refused are an empty `new`, one
    that would change over `most` of the old rows (unless forced), and a result whose rows are not those of `new`; no row
    that changed gives the version there is. `h` in the stored table is each row's hash, and `rid` its id.

    Where another writer publishes meanwhile, the difference is taken anew, from that writer's version, up to `tries`
    times in all. `values` names columns whose value dictionary goes with each version, kept up by the changed rows alone.
    """
    spark = new.sparkSession
    columns = [c for c in new.columns if c not in (rid, "h")]
    lines = numbered(new.select(*columns).withColumn("h", row_hash(columns)), [*key, "h"], "line_")
    lines = materialize(lines, "incoming")
    wanted = table_digest(lines)
    if not wanted[0]:
        raise Refused("no rows")
    for left in reversed(range(tries)):
        now = current_version(spark, root)
        try:
            if now is None:
                counts = value_counts(lines, values) if values else None
                return publish(lines.withColumnRenamed("line_", rid), root, wanted[0], 0, counts), {"new": wanted[0]}
            old = spark.read.parquet(now["path"])
            diff = materialize(snapshot_diff(old, lines, key, rid, "line_"), "diff")
            ops = {r["op"]: r["count"] for r in diff.groupBy("op").count().collect()}
            if set(ops) <= {"same"}:
                return now["version"], ops
            if not force and change_rate(diff, most).first()["refused"]:
                raise Refused(f"over {most:.0%} of the rows would change: {ops}")
            result = materialize(snapshot_apply(old.select(rid, *columns, "h"), lines.select(*columns, "h", "line_"), diff, rid, "line_"), "updated")
            if table_digest(result) != wanted:
                raise Refused("the updated table is not the new one")
            counts = None
            if values and now["values"]:
                counts = changed_counts(stored_counts(spark, open_dictionary(spark, now["values"])), old, lines, diff, rid, "line_", values)
            elif values:
                counts = value_counts(result, values)
            return publish(result, root, wanted[0], now["version"], counts), ops
        except Conflict:
            if not left:
                raise
    raise AssertionError("unreachable")


_VERSION = "version long, rows long, path string, values string"


def publish(df: DataFrame, root: str, expected: int | None = None, base: int | None = None, counts: DataFrame | None = None) -> int:
    """Writes df as the next version under root and returns its number; with value_counts, its dictionary too.

    The rows are written to a folder of their own and counted; then the version's file is created, which only one writer
    can do. So readers see whole versions, a write that stops half-way is never read, and of two writers that start from
    one version (`base`; the newest if not given) the second gets a Conflict."""
    spark = df.sparkSession
    if base is None:
        now = current_version(spark, root)
        base = now["version"] if now else 0
    place = f"{root}/data/{uuid.uuid4().hex}"
    df.write.parquet(f"{place}/rows")
    rows = spark.read.schema(df.schema).parquet(f"{place}/rows").count()
    if expected is not None and rows != expected:
        raise ValueError(f"{rows} rows written, {expected} expected")
    if counts is not None:
        store_dictionary(counts, f"{place}/values")
    told = {"version": base + 1, "rows": rows, "path": f"{place}/rows", "values": f"{place}/values" if counts is not None else None}
    if not create_once(spark, f"{root}/versions/{base + 1:09d}.json", json.dumps(told)):
        raise Conflict(f"version {base + 1} of {root} was published by another writer")
    return base + 1


def current_version(spark: SparkSession, root: str):
    """(version, rows, path, values) of the newest complete version, or None."""
    try:
        listed = spark.read.schema(_VERSION).json(f"{root}/versions")
    except AnalysisException as e:  # nothing was published yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return listed.orderBy(F.desc("version")).first()
