"""The quality classifier's model is of half of all trusted documents, at any number of them."""

import random

from cladeframe.llm import kneser_ney


def test_no_bound_on_trusted_documents(spark):
    n = 6400
    ids = spark.range(n).selectExpr("id AS doc_id", "xxhash64(id) AS h")
    order = [r["doc_id"] for r in ids.orderBy("h").collect()]
    late = order[3100]
    docs = spark.createDataFrame([(i, "q" if i == late else "ab") for i in range(n)], "doc_id long, text string")
    (kept, tables), greatest = kneser_ney.train(docs, ids)
    assert set(kept) == set("abq") and ids.where(f"h <= {greatest}").count() == n // 2
    assert tables[-1][0].agg({"c": "sum"}).first()[0] == (n // 2 - 1) * 3 + 2


def test_median_hash(spark):
    rnd = random.Random(1)
    for n in (0, 1, 2, 5, 3001):
        h = [rnd.randrange(-(1 << 63), 1 << 63) if k % 2 else rnd.randrange(1000) for k in range(n)]
        got = kneser_ney.median_hash(spark.createDataFrame([(k, x) for k, x in enumerate(h)], "doc_id long, h long"))
        assert got == (sorted(h)[-(-n // 2) - 1] if n else None)


def test_ids_are_among(spark):
    docs = spark.range(-5000, 5000).selectExpr("id AS doc_id")
    ids = docs.where("doc_id % 100 = 0")
    left = kneser_ney.may_be_among(docs, ids)
    assert ids.join(left, "doc_id", "left_anti").isEmpty() and left.count() < 200


def test_texts_that_do_not_train_are_not_shuffled(spark):
    """The look-up of trusted ids comes before the shuffle; the texts' table goes once the model is there."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat(chr(cast(97 + id % 5 AS int)), 3) AS text")
    trusted = spark.range(100).selectExpr("id AS doc_id", "xxhash64(id) AS h")
    seen = []
    keep = kneser_ney.materialize

    def watched(df, name):
        seen.append((name, df, keep(df, name)))
        return seen[-1][2]

    kneser_ney.materialize = watched
    try:
        model, _ = kneser_ney.train(docs, trusted)
    finally:
        kneser_ney.materialize = keep
    name, plan, table = seen[0]
    lines = plan._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [x.strip() for x in lines if "Join " in x]
    assert name == "trusted" and "doc_id" in joins[0] and "w_" in joins[1]
    assert model[1][-1][0].agg({"c": "sum"}).first()[0] == 50 * 4
    place = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0])
    assert not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
