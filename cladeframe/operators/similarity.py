"""Exact joins of aligned sequences under a cut of their p-distance, without a table of all pairs.

Equal rows are first made one. The columns are cut in up to 64 segments; a segment is whole in a row if all its bases are
known. Two rows nearer than the cut differ in few known sites, so of the segments that are whole in both only so many can
differ. Each row's segments are put in order of how many rows have the same text there, rarest first: then two such rows
share one of their first M + 1 + SLACK segments (M: the most sites that may differ), as long as each lacks at most SLACK
of the segments that most rows have whole. So rows meet under those segments' texts only, and what most rows have in
common is hardly ever joined on.

Unknown bases are the wildcard: they make a segment unwhole, but never a difference. Rows that lack more than SLACK
segments are laid against all rows instead, in blocks, as are all rows where the cut is too wide for the segments to
tell. Rows of one text are compared in blocks of BLOCK rows, so that a text that many share is many small tasks; texts
that few share are put together in tasks of about BINFUL rows.

Distances are p over sites known in both, null under `least_sites` of them. Null groups and null sequences take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .graph import components

SEGMENTS, SLACK = 64, 8
BLOCK, BINFUL = 256, 2048
LEAST_SITES = 100

_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3] * 2
#: What travels with a row: which it is, its known sites, its label, and three bit planes of its bases.
_ROW = ["id", "known", "label", "planes"]


def _packed(rows: DataFrame, width: int, segment: int) -> DataFrame:
    """(g, id, label, known, planes, segs): planes are the bases' two bits and whether they are known; segs the hashes of
    segments, null where not whole."""
    words = -(-width // 64)
    power = np.random.default_rng(7).integers(1, 2**63, segment, np.uint64) | np.uint64(1)
    count = width // segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            codes = np.full((len(texts), words * 64), 4, np.uint8)
            for k, t in enumerate(texts):
                codes[k, : len(t)] = _CODE[np.frombuffer(t.encode("ascii", "replace"), np.uint8)]
            known = codes < 4
            bits = [np.packbits(x, axis=1) for x in ((codes & 1) == 1, (codes & 2) == 2, known)]
            planes = np.concatenate([bits[0] & bits[2], bits[1] & bits[2], bits[2]], axis=1)
            parts = codes[:, : count * segment].reshape(len(texts), count, segment)
            whole = (parts < 4).all(2)
            hashes = ((parts.astype(np.uint64) + np.uint64(1)) * power).sum(2, dtype=np.uint64).view(np.int64)
            segs = [[int(h) if w else None for h, w in zip(x, y)] for x, y in zip(hashes, whole)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(known.sum(1), pa.int32()), pa.array([x.tobytes() for x in planes], pa.binary()), pa.array(segs, pa.list_(pa.int64()))],
                names=["g", "id", "label", "known", "planes", "segs"],
            )

    return rows.select("g", "id", "label", "s").mapInArrow(run, "g string, id long, label string, known int, planes binary, segs array<long>")


class _Rows:
    """Some rows of a task, ready to be compared."""

    def __init__(self, t: pa.Table):
        self.id = np.array(t.column("id"), np.int64)
        self.known = np.array(t.column("known"), np.int64)
        self.label = np.array([x or "" for x in t.column("label").to_pylist()], object)
        self.named = np.array([bool(x) for x in self.label])
        held = np.frombuffer(b"".join(t.column("planes").to_pylist()), np.uint8).reshape(len(self.id), 3, -1)
        self.one, self.two, self.seen = (np.ascontiguousarray(held[:, k]).view(np.uint64) for k in range(3))

    def __getitem__(self, at) -> _Rows:
        out = _Rows.__new__(_Rows)
        for name, x in vars(self).items():
            setattr(out, name, x[at])
        return out


def _counts(x: _Rows, y: _Rows) -> tuple[np.ndarray, np.ndarray]:
    """(differing sites, sites) of all rows of x with all rows of y."""
    differ, sites = np.zeros((2, len(x.id), len(y.id)), np.int32)
    for k in range(x.one.shape[1]):
        both = x.seen[:, k, None] & y.seen[None, :, k]
        other = (x.one[:, k, None] ^ y.one[None, :, k]) | (x.two[:, k, None] ^ y.two[None, :, k])
        differ += np.bitwise_count(other & both)
        sites += np.bitwise_count(both)
    return differ, sites


#: Given two sets of rows (the same twice for pairs within one), gives the rows of the result.
Compare = Callable[[_Rows, _Rows], dict[str, list]]


def _within(t: pa.Table, compare: Compare, shape: pa.Schema) -> pa.Table:
    """compare, for a task's rows: its keys one after another, with `side` telling which block a row is of."""
    rows, side = _Rows(t), np.array(t.column("side"))
    keys = np.stack([np.array(t.column(c), np.int64) for c in ("gk", "at", "text")], axis=1)
    order = np.lexsort(keys.T)
    cuts = np.flatnonzero((np.diff(keys[order], axis=0) != 0).any(1)) + 1
    out: dict[str, list] = {n: [] for n in shape.names}
    for part in np.split(order, cuts):
        a, b = part[side[part] != 1], part[side[part] != 0]
        a, b = a[np.argsort(rows.id[a])], b[np.argsort(rows.id[b])]
        if len(a) and len(b):
            x = rows[a]
            found = compare(x, x if len(a) == len(b) and (a == b).all() else rows[b])
            for n in shape.names:
                out[n] += list(found[n])
    return pa.table([pa.array(out[n], f.type) for n, f in zip(shape.names, shape)], schema=shape)


def _frame(rows: DataFrame) -> tuple[int, int]:
    """(columns, bases of a segment) for the longest row."""
    width = rows.agg(F.max(F.length("s"))).first()[0] or 1
    return width, max(4, -(-width // SEGMENTS))


def _blocks(keyed: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """keyed rows of keys with more than BLOCK rows, dealt to pairs of blocks (lo, hi); side is 0 or 1 for a block that
    meets another, 2 for one that meets itself."""
    dealt = keyed.join(sizes.select(*keys, F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), keys)
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("b") == F.col("other"), 2).when(F.col("b") < F.col("other"), 0).otherwise(1)
    return dealt.withColumns({"lo": F.least("b", "other"), "hi": F.greatest("b", "other"), "side": side}).drop("b", "other", "parts")


def _compared(rows: DataFrame, cut: float, compare: Compare, shape: str) -> DataFrame:
    """compare's results for enough sets of `rows` (g, id, label, s) that any two rows nearer than the cut are in one."""
    spark = rows.sparkSession
    schema = _arrow_schema(shape)
    width, segment = _frame(rows)
    packed = materialize(_packed(rows, width, segment), "packed")
    base = packed.select("g", *_ROW, F.xxhash64("g").alias("gk"))

    tokens = packed.select("g", "id", F.posexplode("segs").alias("at", "text")).where("text is not null")
    most = packed.groupBy("g").agg((F.count("*") / 2).alias("half"))
    usual = tokens.groupBy("g", "at").agg(F.count("*").alias("n")).join(most, "g").where("n >= half").select("g", "at")
    usual = materialize(usual, "usual_segments")  # at most SEGMENTS rows a group
    kinds = usual.groupBy("g").agg(F.count("*").alias("usual"))
    may_differ = max(0, int(np.ceil(cut * width)) - 1)
    lead = may_differ + 1 + SLACK
    own = tokens.join(usual, ["g", "at"])
    have = packed.select("g", "id").join(own.groupBy("g", "id").agg(F.count("*").alias("have")), ["g", "id"], "left").join(kinds, "g", "left")
    regular = (F.coalesce("have", F.lit(0)) >= F.coalesce("usual", F.lit(0)) - SLACK) & (F.coalesce("usual", F.lit(0)) - 2 * SLACK > may_differ)
    told = materialize(have.select("g", "id", regular.alias("regular")), "regular")

    # Regular rows meet under the texts of their rarest segments.
    own = own.join(told.where("regular"), ["g", "id"], "left_semi")
    counts = own.groupBy("g", "at", "text").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("g", "id").orderBy("n", "at"))
    index = own.join(counts, ["g", "at", "text"]).withColumn("r", first).where((F.col("r") <= lead) & (F.col("n") > 1)).select("g", "id", "at", "text")
    index = materialize(index, "index")
    sizes = materialize(index.groupBy("g", "at", "text").agg(F.count("*").alias("n")).where("n > 1"), "texts")
    keyed = index.join(base, ["g", "id"]).select("gk", "at", "text", "g", *_ROW)
    few, many = sizes.where(F.col("n") <= BLOCK), sizes.where(F.col("n") > BLOCK)
    bins = max(1, (few.agg(F.sum("n")).first()[0] or 0) // BINFUL)
    keys = ["g", "at", "text"]
    small = keyed.join(few.select(*keys), keys, "left_semi").withColumn("side", F.lit(2)).withColumn("bin", F.pmod(F.xxhash64(*keys), F.lit(bins)))
    columns = ["gk", "at", "text", *_ROW, "side"]
    run = lambda t: _within(t, compare, schema)
    found = small.select("bin", *columns).groupBy("bin").applyInArrow(run, shape)
    large = _blocks(keyed, many, keys)
    found = found.unionByName(large.select("lo", "hi", *columns).groupBy("gk", "at", "text", "lo", "hi").applyInArrow(run, shape))

    # All others are laid against all rows.
    return found.unionByName(_against(base.join(told.where("not regular").select("g", "id"), ["g", "id"], "left_semi"), base, compare, shape))


def _against(some: DataFrame, base: DataFrame, compare: Compare, shape: str) -> DataFrame:
    """compare's results for `some` of the packed rows on one side, and all of their group on the other, in blocks."""
    schema = _arrow_schema(shape)
    size = lambda df, n: df.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n))
    parts = size(some, "a").join(size(base, "b"), "g")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    whole = base.join(parts, "g").withColumns({"hi": block("b"), "lo": F.explode(F.sequence(F.lit(0), F.col("a") - 1)), "side": F.lit(1)})
    odd = some.join(parts, "g").withColumns({"lo": block("a"), "hi": F.explode(F.sequence(F.lit(0), F.col("b") - 1)), "side": F.lit(0)})
    both = whole.unionByName(odd).withColumns({"at": F.lit(-1), "text": F.lit(0).cast("long")})
    run = lambda t: _within(t, compare, schema)
    return both.select("lo", "hi", "gk", "at", "text", *_ROW, "side").groupBy("gk", "lo", "hi").applyInArrow(run, shape)


def _arrow_schema(shape: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(shape))


def _distinct(df: DataFrame, group: Column, rid: str, seq: str, label: Column) -> DataFrame:
    """(g, s, label, id, copies): rows that are equal in group, sequence and label, under their least id."""
    own = df.select(group.cast("string").alias("g"), F.upper(seq).alias("s"), F.coalesce(label, F.lit("")).alias("label"), F.col(rid).cast("long").alias("r"))
    return own.where("g is not null and s is not null").groupBy("g", "s", "label").agg(F.min("r").alias("id"), F.count("*").alias("copies"))


def _known(s: str) -> Column:
    return F.length(F.regexp_replace(s, "[^ACGT]", ""))


def close_groups(df: DataFrame, group: Column, rid: str, seq: str, cut: float, least_sites: int = LEAST_SITES) -> DataFrame:
    """(rid, label): single-linkage groups of the rows of df, chained within a group by pairs nearer than `cut`; the label
    is the least id. Rows without a group or a sequence are alone."""
    rows = materialize(_distinct(df, group, rid, seq, F.lit("")), "distinct_rows")

    def compare(x: _Rows, y: _Rows) -> dict[str, list]:
        differ, sites = _counts(x, y)
        near = (sites >= least_sites) & (differ / np.maximum(sites, 1) < cut)
        if x is not y:  # rows of both sides stand side by side
            n = len(x.id)
            every = np.zeros((n + len(y.id),) * 2, bool)
            every[:n, n:], every[n:, :n] = near, near.T
            near, ids = every, np.concatenate([x.id, y.id])
        else:
            ids = x.id
        out: dict[str, list] = {"a": [], "b": []}
        left = np.ones(len(ids), bool)
        for k in range(len(ids)):
            if not left[k]:
                continue
            reached = np.zeros(len(ids), bool)
            reached[k] = edge = True
            edge = reached
            while edge.any():
                edge = near[edge].any(0) & ~reached
                reached = reached | edge
            left &= ~reached
            others = ids[reached & (ids != ids[k])]
            out["a"] += [int(ids[k])] * len(others)
            out["b"] += others.tolist()
        return out

    found = _compared(rows, cut, compare, "a long, b long")
    told = components(rows.select(F.col("id").alias("node")), found)
    # Copies are at distance 0, where they have the sites for any distance.
    alike = rows.where(F.lit(cut > 0) & (_known("s") >= least_sites)).select("g", "s", F.col("id").alias("node")).join(told, "node").select("g", "s", "label")
    own = df.select(F.col(rid).cast("long").alias(rid), group.cast("string").alias("g"), F.upper(seq).alias("s"))
    return own.join(alike.hint("merge"), ["g", "s"], "left").select(rid, F.coalesce("label", rid).alias("label"))


def nearest_within(df: DataFrame, group: Column, rid: str, seq: str, label: Column, cut: float, least_sites: int = LEAST_SITES) -> DataFrame:
    """(rid, own, nn, nn_id): for each labelled row with any such neighbour within a group at most at distance `cut`: the
    least distance to another row of its label, and to a row of another, with the least id of those nearest."""
    labelled = df.where(label.isNotNull() & (label != ""))
    rows = materialize(_distinct(labelled, group, rid, seq, label), "distinct_rows")

    def compare(x: _Rows, y: _Rows) -> dict[str, list]:
        differ, sites = _counts(x, y)
        d = np.where((sites >= least_sites) & (differ <= cut * sites + 1e-9), differ / np.maximum(sites, 1), np.inf)
        d[d > cut] = np.inf
        same = x.label[:, None] == y.label[None, :]
        d[x.id[:, None] == y.id[None, :]] = np.inf
        out: dict[str, list] = {"id": [], "own": [], "nn": [], "nn_id": []}
        for rows_, other, dd, ss in ((x, y, d, same), (y, x, d.T, same.T)) if x is not y else ((x, y, d, same),):
            own, far = np.where(ss, dd, np.inf).min(1), np.where(ss, np.inf, dd)
            at = far.argmin(1)  # ids are in order: of equals the least
            nn = far[np.arange(len(at)), at]
            hit = np.isfinite(own) | np.isfinite(nn)
            out["id"] += rows_.id[hit].tolist()
            out["own"] += [v if np.isfinite(v) else None for v in own[hit].tolist()]
            out["nn"] += [v if np.isfinite(v) else None for v in nn[hit].tolist()]
            out["nn_id"] += [i if np.isfinite(v) else None for v, i in zip(nn[hit].tolist(), other.id[at][hit].tolist())]
        return out

    found = _compared(rows, np.nextafter(cut, 1), compare, "id long, own double, nn double, nn_id long")
    best = found.groupBy("id").agg(F.min("own").alias("own"), F.min(F.when(F.col("nn").isNotNull(), F.struct("nn", "nn_id"))).alias("x"))
    copied = (F.col("copies") > 1) & (_known("s") >= least_sites)
    told = rows.join(best, "id", "left").select("g", "s", "label", F.when(copied, 0.0).otherwise(F.col("own")).alias("own"), "x.nn", "x.nn_id").where("own is not null or nn is not null")
    own = labelled.select(group.cast("string").alias("g"), F.upper(seq).alias("s"), label.alias("label"), F.col(rid).cast("long").alias(rid))
    return own.join(told.hint("merge"), ["g", "s", "label"]).select(rid, "own", "nn", "nn_id")


def nearest_of_label(df: DataFrame, some: DataFrame, group: Column, rid: str, seq: str, label: Column, least_sites: int = LEAST_SITES) -> DataFrame:
    """(rid, own): for the ids in `some`, the least distance, however great, to another row of the same group and label;
    without any such row they are left out."""
    labelled = df.where(label.isNotNull() & (label != "")).select(group.cast("string").alias("g"), F.upper(seq).alias("s"), label.alias("label"), F.col(rid).cast("long").alias("r"))
    labelled = labelled.where("g is not null and s is not null")
    asked = labelled.join(some.select(F.col(rid).cast("long").alias("r")), "r", "left_semi")
    rows = labelled.join(asked.select("g", "label").distinct(), ["g", "label"], "left_semi")
    rows = materialize(rows.select(F.concat_ws("\u001f", "g", "label").alias("g"), "s", "label", F.col("r").alias("id")), "rows_of_labels")
    packed = materialize(_packed(rows, *_frame(rows)), "packed").select("g", *_ROW, F.xxhash64("g").alias("gk"))

    def compare(x: _Rows, y: _Rows) -> dict[str, list]:
        differ, sites = _counts(x, y)
        d = np.where((sites >= least_sites) & (x.id[:, None] != y.id[None, :]), differ / np.maximum(sites, 1), np.inf).min(1)
        hit = np.isfinite(d)
        return {"id": x.id[hit].tolist(), "own": d[hit].tolist()}

    found = _against(packed.join(asked.select(F.col("r").alias("id")), "id", "left_semi"), packed, compare, "id long, own double")
    return found.groupBy(F.col("id").alias(rid)).agg(F.min("own").alias("own"))
