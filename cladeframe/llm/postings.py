"""Benchmark passages in training text, by a positional inverted index.

The index is a stored table of postings (t, d, h, p): the word numbered t stands at place p of the document with id d and
text hash h. Its files are made of the documents that one task read, in order of t, so that nothing is shuffled to build
it and a search for a few words skips most of each file. It holds the words that the test phrases use, and each
document's end as a word of its own, whose place is the document's length.

A phrase is searched from its rarest word: every posting of that, less the word's offset in the phrase, is a place where
the phrase may begin; these lists are intersected with the second rarest word's postings, less its offset, then with the
third's. The few places left are intersected with the lists of all other words; of the index, only documents that have
such a place travel then (told by a table of fixed size, which at worst lets too many through). `proximity_matches` does
the same with every offset up to a span.

All joins of postings are on (d, h, t, p), where no key is hot, but for the first, from words to phrases, and the last, to
items and documents, where hot keys are dealt. A window is as many consecutive words as `width`, or the whole of a
phrase that is shorter.

Cases: null and blank texts have no words and match nothing; rows equal in id and text are one document and each get the
row; null ids take part; items of equal id are one item, and an item without an id is named by the empty string; equal
items are searched once; an empty table on either side gives no matches; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import NO_ID, id_key, spread_join

#: What separates words: all ASCII but digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WIDTH = 10
#: So many of a phrase's rarest words are searched one after another, the others together.
ONE_BY_ONE = 3
#: Slots of the filter over documents, 64 to a row: 65,536 rows of two numbers at most.
SLOTS = 1 << 22
_END = "\x00"  # not a word: stands for a document's end
_END_T = -1
_DOC = ["d", "h"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    """A-Z lower-cased, other letters kept."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def split_words(text: Column) -> Column:
    """Words of a text in order, not yet lower-cased."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK, -1), "")


def windows_of(items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(w, terms): distinct windows of the items, numbered; and (w, item): which items hold them."""
    words = F.transform(split_words(F.col("text")), lower_ascii)
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words")).where(F.size("words") > 0)
    # Cut within the expression: a long item's words are not copied for each of its windows.
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - width, F.lit(0))), lambda s: F.slice("words", s + 1, width))
    held = materialize(own.select("item", F.explode(F.array_distinct(cut)).alias("terms")).distinct(), "item_windows")
    windows = materialize(held.select("terms").distinct().withColumn("w", F.monotonically_increasing_id()), "windows")
    return windows, materialize(held.join(windows.hint("merge"), "terms").select("w", "item"), "window_items")


def vocabulary_of(windows: DataFrame) -> DataFrame:
    """(term, t): the words that windows use, numbered, and a document's end."""
    terms = windows.select(F.explode("terms").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id())
    return materialize(terms.unionByName(windows.sparkSession.createDataFrame([(_END, _END_T)], "term string, t long")), "vocabulary")


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(t, d, h, p): the stored postings of the vocabulary's words."""
    words = F.posexplode(F.array_append(split_words(F.col("text")), F.lit(_END))).alias("p", "term")
    placed = docs.select(id_key(F.col("doc_id")).alias("d"), F.xxhash64("text").alias("h"), words).withColumn("term", lower_ascii(F.col("term")))
    return materialize(placed.join(vocabulary, "term").select("t", *_DOC, "p").sortWithinPartitions("t", *_DOC, "p"), "postings")


def ranked_words(windows: DataFrame, vocabulary: DataFrame, index: DataFrame) -> DataFrame:
    """(w, size, r, t, off, n): the words of windows, the rarest in the index first (r from 1), with offset and number of
    postings; windows with a word that the index has not are left out, as they can match nowhere."""
    counts = index.groupBy("t").agg(F.count("*").alias("n"))
    terms = vocabulary.join(counts, "t")
    each = windows.select("w", F.size("terms").alias("size"), F.posexplode("terms").alias("off", "term")).join(terms, "term")
    own = Window.partitionBy("w")
    told = each.withColumn("r", F.row_number().over(own.orderBy("n", "t", "off"))).withColumn("found", F.count("*").over(own))
    return materialize(told.where("found = size").select("w", "size", "r", "t", "off", "n"), "ranked_words")


def _rarest(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """(w, size, d, h, p, off, and t2, off2, t3, off3): postings of each window's rarest word, and what to search next."""
    later = [F.max(F.when(F.col("r") == k, F.col(c))).alias(f"{c}{k}") for k in range(2, ONE_BY_ONE + 1) for c in ("t", "off")]
    first = [F.max(F.when(F.col("r") == 1, F.col(c))).alias(c) for c in ("t", "off", "n")]
    each = ranked.groupBy("w", "size").agg(*first, *later)
    mine = F.struct("w", "size", "off", *[f"{c}{k}" for k in range(2, ONE_BY_ONE + 1) for c in ("t", "off")])
    firsts = materialize(each.groupBy("t").agg(F.collect_list(mine).alias("own"), F.max("n").alias("n_")), "rarest_words")
    met = spread_join(index.join(firsts.select("t"), "t", "left_semi"), firsts, ["t"], F.struct(*_DOC, "p"))
    return met.select(*_DOC, "p", F.explode("own").alias("x")).select(*_DOC, "p", "x.*")


def _of_documents(index: DataFrame, places: DataFrame) -> DataFrame:
    """The postings of all documents that places are in, and of few others: a slot of a table of fixed size tells."""
    slot = F.pmod(F.xxhash64(*_DOC), F.lit(SLOTS))
    row, bit = F.shiftright(slot, 6), slot.bitwiseAND(63).cast("int")
    used = places.select(row.alias("row"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("m")).groupBy("row").agg(F.bit_or("m").alias("m"))
    held = index.withColumn("row", row).join(F.broadcast(used), "row").where(F.call_function("shiftright", F.col("m"), bit).bitwiseAND(1) == 1)
    return held.select("t", *_DOC, "p")


def phrase_matches(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """(w, size, d, h, b, n_): places b where all words of window w follow one another in the document, which n_ rows hold."""
    left = _rarest(index, ranked).withColumn("b", F.col("p") - F.col("off")).where("b >= 0")
    for k in range(2, ONE_BY_ONE + 1):
        wanted = ranked.where(F.col("r") == k).select("t").distinct()
        lists = index.join(wanted, "t", "left_semi").select(F.col("t").alias(f"t{k}"), *_DOC, F.col("p").alias("q"))
        due = left.where(f"t{k} is not null").withColumn("q", F.col("b") + F.col(f"off{k}"))
        left = due.join(lists.hint("merge"), [*_DOC, f"t{k}", "q"], "left_semi").drop("q").unionByName(left.where(f"t{k} is null"))
    place = ["w", "size", *_DOC, "b"]
    left = materialize(left.groupBy(*place).agg(F.count("*").alias("n_")), "places")
    rest = ranked.where(F.col("r") > ONE_BY_ONE).groupBy("w").agg(F.collect_list(F.struct("t", "off")).alias("rest"))
    held = left.groupBy("w").agg(F.count("*").alias("n_"))
    each = spread_join(left.withColumnRenamed("n_", "rows"), materialize(rest.join(held, "w"), "other_words"), ["w"], F.struct(*_DOC, "b"))
    each = each.select(*place, "rows", F.explode("rest").alias("x")).select(*place, "rows", "x.t", (F.col("b") + F.col("x.off")).alias("p"))
    lists = _of_documents(index.join(ranked.where(F.col("r") > ONE_BY_ONE).select("t").distinct(), "t", "left_semi"), left)
    met = each.join(lists.hint("merge"), [*_DOC, "t", "p"], "left_semi").groupBy(*place).agg(F.count("*").alias("k"), F.max("rows").alias("n_"))
    long = met.where(F.col("k") == F.col("size") - ONE_BY_ONE).drop("k")
    return materialize(long.unionByName(left.where(F.col("size") <= ONE_BY_ONE)), "phrase_matches")


def proximity_matches(index: DataFrame, ranked: DataFrame, span: int) -> DataFrame:
    """(w, d, h, b, e): places b, e where all distinct words of window w stand, in any order, within `span` words: for each
    posting of the rarest word the shortest such stretch, of equal ones the first, that holds it."""
    words = ranked.groupBy("w", "t").agg(F.min("r").alias("r"))
    others = words.where("r > 1").groupBy("w").agg(F.collect_list("t").alias("ts"))
    near = _rarest(index, ranked).select("w", *_DOC, "p").distinct().join(others, "w", "left")
    part = lambda x: F.floor(x / span).cast("int")  # noqa: E731  (two places within a span lie in one part or in neighbours)
    alone = near.where("ts is null").select("w", *_DOC, F.col("p").alias("b"), F.col("p").alias("e"))
    wanted = near.where("ts is not null").select("w", *_DOC, "p", F.size("ts").alias("m"), F.explode("ts").alias("t"))
    wanted = wanted.withColumn("part", F.explode(F.sequence(part(F.greatest(F.col("p") - span + 1, F.lit(0))), part(F.col("p") + span - 1))))
    lists = _of_documents(index, near.where("ts is not null")).select(*_DOC, "t", F.col("p").alias("q"), part(F.col("p")).alias("part")).distinct()
    met = wanted.join(lists.hint("merge"), [*_DOC, "t", "part"]).where(F.abs(F.col("q") - F.col("p")) < span)
    each = met.groupBy("w", *_DOC, "p", "m").agg(F.collect_list(F.struct("q", "t")).alias("x"), F.count_distinct("t").alias("k")).where("k = m")
    # A stretch begins at one of these places or at p, and ends where the last of the words is met for the first time.
    begins = F.array_distinct(F.concat(F.array("p"), F.filter(F.transform("x", lambda v: v["q"]), lambda q: q < F.col("p"))))
    own = each.withColumn("b", F.explode(begins)).withColumn("x", F.filter("x", lambda v: v["q"] >= F.col("b")))
    ends = own.select("w", *_DOC, "p", "m", "b", F.explode("x").alias("v")).groupBy("w", *_DOC, "p", "m", "b", "v.t").agg(F.min("v.q").alias("q"))
    ends = ends.groupBy("w", *_DOC, "p", "m", "b").agg(F.greatest(F.max("q"), "p").alias("e"), F.count("*").alias("k")).where((F.col("k") == F.col("m")) & (F.col("e") < F.col("b") + span))
    best = ends.groupBy("w", *_DOC, "p").agg(F.min(F.struct((F.col("e") - F.col("b")).alias("n"), "b", "e")).alias("x"))
    return best.select("w", *_DOC, "x.b", "x.e").unionByName(alone).distinct()


def _hit_words(matches: DataFrame) -> DataFrame:
    """(d, h, n_hit, n_): words within any match, in documents that n_ rows hold. A document's matches are sorted in one
    task: there are no more than its words."""
    starts = matches.groupBy(*_DOC, "b").agg(F.max("size").alias("size"), F.max("n_").alias("n_"))
    end = F.col("b") + F.col("size")
    before = F.max(end).over(Window.partitionBy(*_DOC).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(end - F.greatest("b", F.coalesce(before, F.col("b"))), F.lit(0))
    return starts.select(*_DOC, "n_", fresh.alias("x")).groupBy(*_DOC).agg(F.sum("x").cast("long").alias("n_hit"), F.max("n_").alias("n_"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit (words within any occurrence of a window), n_items, items (sorted), contaminated."""
    windows, holders = windows_of(items, width)
    vocabulary = vocabulary_of(windows)
    index = build_index(docs, vocabulary)
    matches = phrase_matches(index, ranked_words(windows, vocabulary, index))
    pairs = matches.select("w", *_DOC).distinct()
    named = holders.groupBy("w").agg(F.collect_set("item").alias("items")).join(pairs.groupBy("w").agg(F.count("*").alias("n_")), "w")
    found = spread_join(pairs, materialize(named, "named_windows"), ["w"], F.struct(*_DOC)).select(*_DOC, F.explode("items").alias("item"))
    found = found.groupBy(*_DOC).agg(F.sort_array(F.collect_set("item")).alias("items"))
    told = materialize(_hit_words(matches).join(found.hint("merge"), _DOC), "contaminated")
    ends = index.where(F.col("t") == _END_T).select(*_DOC, F.col("p").cast("long").alias("n_words"))
    both = spread_join(ends, told, _DOC, F.col("n_words"), "left")
    return both.select(
        F.nullif("d", F.lit(NO_ID)).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """contamination's columns, the items as the hash of their list."""
    return contamination(docs, items).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")
