"""The value dictionary, versions that exclude each other, and a session's stored tables."""

import random
import threading
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cladeframe import queries as R
from cladeframe.operators import dictionary, ingest, reports
from cladeframe.plans import materialize as M
from cladeframe.sources import sinks
from cladeframe.streaming import feeds


def brute(rows, columns, q, limit=10):
    fold = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    n = Counter((k, v) for r in rows for k, v in enumerate(r) if v is not None)
    first = {}
    for (k, v), c in sorted(n.items()):
        if fold(q) in fold(v):
            first.setdefault(v, (columns[k], c))
    tier = lambda v: 0 if fold(v).startswith(fold(q)) else 1 if " " + fold(q) in fold(v) else 2
    best = sorted(first, key=lambda v: (tier(v), -first[v][1], len(v), v))[:limit]
    return [(v, *first[v]) for v in best]


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(1)
    part = ["red", "Blue", "ring", "bolt", "éclair", "Ériu", "gizmo", "regal", " odd", "blue  two", "", "zinc"]
    rows = [tuple(None if rnd.random() < 0.1 else " ".join(rnd.sample(part, rnd.randrange(1, 4))) for _ in "ab") for _ in range(800)]
    return rows, spark.createDataFrame(rows, "a string, b string").repartition(7)


@pytest.fixture
def many_files(spark):
    """Small tables, too, are written as several files."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_suggestions(spark, table, tmp_path, many_files):
    rows, df = table
    d = dictionary.store_dictionary(dictionary.value_counts(df, ["a", "b"]), f"file://{tmp_path}/d")
    assert len(d.ranges) > 1
    again = dictionary.open_dictionary(spark, f"file://{tmp_path}/d")
    for q in ("re", "RE", "blue", "éc", "É", "zm", "", "two", "absent", "ed r", "blue  t", " odd"):
        assert [tuple(r) for r in dictionary.suggest(spark, again, q).collect()] == brute(rows, "ab", q), q
    none = dictionary.store_dictionary(dictionary.value_counts(df.limit(0), ["a", "b"]), f"file://{tmp_path}/e")
    assert dictionary.suggest(spark, none, "re").count() == 0


def test_a_prefix_reads_one_file(spark, tmp_path, many_files):
    df = spark.range(20_000).select(F.concat(F.lit("name "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("v"))
    d = dictionary.store_dictionary(dictionary.value_counts(df, ["v"]), f"file://{tmp_path}/d")
    assert len(d.ranges) == 4
    found = dictionary.starting(spark, d, "Name 0123")
    assert len(found.inputFiles()) == 1 and found.count() == 100
    assert dictionary.starting(spark, d, "012345").select("value", "tier").collect() == [("name 012345", 1)]
    assert dictionary.starting(spark, d, "zzz").count() == 0


def test_dictionary_goes_with_versions(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rows = [(k, f"v{k % 7}", f"w {k % 3}") for k in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "k long, a string, b string")
    counted = lambda rows: {(k, v): n for (k, v), n in Counter((c, r[c + 1]) for r in rows for c in range(2) if r[c + 1] is not None).items()}

    def held():
        now = ingest.current_version(spark, root)
        return {(r["k"], r["value"]): r["n"] for r in dictionary.stored_counts(spark, dictionary.open_dictionary(spark, now["values"])).collect()}

    ingest.update(frame(rows), root, ["k"], values=["a", "b"])
    assert held() == counted(rows)
    rows = [(0, "new", None), *rows[1:290], (1000, "v1", "late")]
    assert ingest.update(frame(rows), root, ["k"], values=["a", "b"])[0] == 2
    assert held() == counted(rows)
    rows[5] = (5, "v0", "w 0")
    assert ingest.update(frame(rows), root, ["k"])[0] == 3  # a version without a dictionary
    assert ingest.current_version(spark, root)["values"] is None
    rows[6] = (6, "v9", "w 0")
    assert ingest.update(frame(rows), root, ["k"], values=["a", "b"])[0] == 4
    assert held() == counted(rows)


def test_two_writers(spark, tmp_path):
    """Started together from one version: both changes are there in the end, each in a version of its own."""
    root = f"file://{tmp_path}/t"
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    base = [(k, f"v{k}") for k in range(200)]
    ingest.update(frame(base), root, ["k"])
    start, out = threading.Barrier(2), {}

    def write(name):
        start.wait()
        out[name] = ingest.update(frame([(0, name), *base[1:]]), root, ["k"])

    both = [threading.Thread(target=write, args=(n,)) for n in ("one", "two")]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(v for v, _ in out.values()) == [2, 3]
    last = max(out, key=lambda n: out[n][0])
    for v, name in ((2, min(out, key=lambda n: out[n][0])), (3, last)):
        path = spark.read.json(f"{root}/versions").where(F.col("version") == v).first()["path"]
        assert {r["k"]: r["v"] for r in spark.read.parquet(path).collect()} == dict(base) | {0: name}


def test_a_taken_version_is_refused(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    rows = [(k, "v") for k in range(100)]
    assert ingest.update(frame(rows), root, ["k"])[0] == 1
    first = ingest.current_version(spark, root)
    assert ingest.publish(spark.read.parquet(first["path"]), root, base=1) == 2
    with pytest.raises(ingest.Conflict):
        ingest.publish(spark.read.parquet(first["path"]).limit(3), root, base=1)
    assert ingest.current_version(spark, root)["rows"] == 100
    tries = [0]
    seen = ingest.current_version

    def stale(*a):  # every look shows a version that is no longer the last
        tries[0] += 1
        return first

    ingest.current_version = stale
    try:
        with pytest.raises(ingest.Conflict):
            ingest.update(frame([(0, "other"), *rows[1:]]), root, ["k"], tries=3)
    finally:
        ingest.current_version = seen
    assert tries[0] == 3


def test_create_once(spark, tmp_path):
    won = []
    start = threading.Barrier(8)

    def go(k):
        start.wait()
        won.append(M.create_once(spark, f"file://{tmp_path}/x/one", f"text {k}") and k)

    threads = [threading.Thread(target=go, args=(k,)) for k in range(1, 9)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winner = [k for k in won if k]
    assert len(winner) == 1 and (tmp_path / "x/one").read_text() == f"text {winner[0]}"
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.endswith(".crc")] == ["one"]


def test_clear_and_rewritten_tables(spark, tmp_path, sf):
    before = sorted(map(tuple, R.Q["zone_richness"](spark, sf).collect()))
    M.clear(spark)
    assert sorted(map(tuple, R.Q["zone_richness"](spark, sf).collect())) == before
    assert R.Q["suggest_values"](spark, sf).count() == 10
    path = f"file://{tmp_path}/part.parquet"
    made = defaultdict(int)

    def build():
        made["n"] += 1
        return made["n"]

    spark.range(3).write.parquet(path)
    assert [M.once(spark, "x", [path], build) for _ in range(2)] == [1, 1]
    spark.range(4).write.mode("overwrite").parquet(path)
    assert M.once(spark, "x", [path], build) == 2


def test_snapshots_as_a_stream(spark, tmp_path):
    """The operations of arriving snapshots are those of snapshot_diff on the same rows."""
    rnd = random.Random(5)
    shape = "p string, m string, h string, at timestamp, id long"
    versions, rows = [[]], []
    for v in range(4):
        rows = [(f"p{k // 3}", "COI" if k % 3 else None, f"h{rnd.randrange(4)}") for k in range(60) if rnd.random() < 0.8 and not (v == 2 and k < 12)]
        versions.append(rows + rows[:2])
    place = f"file://{tmp_path}/in"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", feeds.STATE_STORE)
    try:
        got = []
        for v, rows in enumerate(versions[1:], 1):
            df = spark.createDataFrame(rows, "p string, m string, h string").withColumn("at", F.timestamp_seconds(F.lit(1000 * v)))
            df.coalesce(1).write.mode("append").parquet(place)
            stream = spark.readStream.schema("p string, m string, h string, at timestamp").parquet(place)
            out = feeds.snapshot_operations(stream, ["p", "m"], "at", "h")
            write = lambda df, k: got.extend(map(tuple, df.select("p", "m", "at", "op", "n").collect()))
            q = out.writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).foreachBatch(write).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    told = Counter()
    for p, m, at, op, n in got:
        told[p, m, int(at.timestamp()) // 1000, op] += n
    want = Counter()
    for v in range(1, 5):
        frame = lambda rows: spark.createDataFrame([(*r, None, k) for k, r in enumerate(rows)], shape)
        old, new = frame(versions[v - 1]), frame(versions[v])
        where = {("old_id", k): r for k, r in enumerate(versions[v - 1])} | {("new_id", k): r for k, r in enumerate(versions[v])}
        for r in reports.snapshot_diff(old, new, ["p", "m"], "id", "id").collect():
            side = "old_id" if r["old_id"] is not None else "new_id"
            p, m, _ = where[side, r[side]]
            want[p, m or "", v, r["op"]] += 1
    assert told == want
    assert {k[3] for k in want} == {"same", "chg", "gone", "new"}


def test_batch_as_files(spark, tmp_path):
    terms = ["Aedes sp", "Aedes/sp", "aedes_sp", "Culex", "Nosuch", "", "Ünï code"]
    rows = [(t, k) for t in terms[:4] + terms[6:] for k in range(3)]
    listed = spark.createDataFrame([(t,) for t in [*terms, "Culex"]], "term string")
    names = {r["term"]: r["folder"] for r in sinks.folder_names(listed, "term").collect()}
    assert names == {"Aedes sp": "Aedes_sp", "Aedes/sp": "Aedes_sp~2", "aedes_sp": "aedes_sp~3", "Culex": "Culex", "Nosuch": "Nosuch", "": "_", "Ünï code": "_n_code"}
    sinks.write_batch(spark.createDataFrame(rows, "term string, n int"), listed, "term", f"file://{tmp_path}/out")
    back = spark.read.options(header=True, sep="\t").csv(f"file://{tmp_path}/out/records")
    assert {(r["_term"], r["term"], int(r["n"])) for r in back.collect()} == {(names[t], t, k) for t, k in rows}
    told = spark.read.options(header=True, sep="\t").csv(f"file://{tmp_path}/out/summary").collect()
    assert sorted((r["term"], r["folder"], r["records"]) for r in told) == sorted((t, names[t], "3") for t in {r[0] for r in rows})
    assert sorted(r["value"] or "" for r in spark.read.text(f"file://{tmp_path}/out/not_found").collect()) == ["", "Nosuch"]
