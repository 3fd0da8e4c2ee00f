"""Spelling variants: words one edit apart, found by merging the light subtrees of a trie.

The trie of all words is kept as a table of (word, depth, node, next character), a node being the hash of a prefix. The
heavy child of a node is the one with most words below it; every other child is light, and a word passes few light edges
(at most the logarithm of the number of words, since each halves what is left). At each light edge, from node v by
character c, the word's terminal is merged, small subtree into large one, into the error trees of v:

- c replaced by the heavy character: it meets the terminal of v + heavy + rest, if that is a word;
- c replaced by any: it meets the other light words with the same v and rest, at most one per character;
- c skipped: it meets v + rest;
- the heavy character skipped on the other side: it meets v + heavy + c + rest, as a word that ends at v meets v + heavy.

Two words that differ by one replaced, inserted or deleted character part at one node, where at least one of them takes a
light edge or ends; so terminals that coincide give every pair, and each word emits a few terminals, not one for each of
its characters. Prefixes are hashed one from the next (modulo 2^127 - 1), so a word of any length takes rows in proportion.

Cases: a null or blank text has no words; a null id counts as an empty one; rows of equal id and text count as often as
they are there; of equally frequent near words the least in code-point order is taken; no words give an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import spread_join
from .postings import lower_ascii

#: What separates runs of letters.
NO_LETTER = r"[^A-Za-zÀ-ÿ]+"
LEAST_CHARS, LEAST_N, RATIO, SLIP = 6, 5, 5, 199
_PRIME, _BASE = (1 << 127) - 1, 0x1E3779B97F4A7C15F39CC0605CEDC835
_ANY = "\x00"  # stands for the replaced character; no word holds it
_ROWS = 1 << 16


def count_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, slip: int | None = SLIP) -> DataFrame:
    """(word, n): lower-cased runs of letters with their numbers of occurrences. A run slips, that is, loses a character,
    if `slip` divides the crc32 of its document's id and itself; None keeps all runs as they are."""
    runs = docs.select("doc_id", F.explode(F.split("text", NO_LETTER, -1)).alias("run")).where(F.length("run") >= least_chars)
    run = runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))
    word = F.col("run")
    if slip:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(h % slip == 0, cut).otherwise(word)
    return run.select(word.alias("word")).where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _trie(words: DataFrame) -> DataFrame:
    """(id, i, node, c): for every word and depth, the prefix's hash and the next character; null where the word ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["id", "i", "node", "c"], [pa.int64(), pa.int32(), pa.binary(), pa.string()]
        rows: list[tuple] = []

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            return batch

        for b in batches:
            for key, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = 0
                for i, c in enumerate(word):
                    rows.append((key, i, h.to_bytes(16), c))
                    h = (h * _BASE + ord(c) + 1) % _PRIME
                    if len(rows) >= _ROWS:
                        yield told()
                rows.append((key, len(word), h.to_bytes(16), None))
        if rows:
            yield told()

    return words.select("id", "word").mapInArrow(run, "id long, i int, node binary, c string")


def _light_edges(words: DataFrame) -> DataFrame:
    """(word, n, i, c, heavy): where words leave the heavy path, or end (null c) at a node that goes on."""
    trie = materialize(_trie(words), "trie")
    below = trie.groupBy("node", "c").agg(F.count("*").alias("k"))
    first = F.min(F.when(F.col("c").isNotNull(), F.struct(-F.col("k"), "c")))["c"]
    nodes = below.groupBy("node").agg(first.alias("heavy"), F.count("*").alias("ways"), F.sum("k").alias("n_")).where("ways > 1 and heavy is not null").drop("ways")
    met = spread_join(trie, materialize(nodes, "branches"), ["node"], F.col("id")).where("c is null or c <> heavy").drop("node")
    return met.join(words.hint("merge"), "id").select("word", "n", "i", "c", "heavy")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): for the words of (id, word, n) that have words one edit away, how many, and (-n, word) of the
    most frequent."""
    light = materialize(_light_edges(words), "light_edges")
    head, tail, rest = F.substring("word", F.lit(1), F.col("i")), F.substring("word", F.col("i") + 1, F.length("word")), F.substring("word", F.col("i") + 2, F.length("word"))
    aims = F.when(F.col("c").isNull(), F.array(F.concat(head, "heavy"))).otherwise(F.array(F.concat(head, "heavy", rest), F.concat(head, "heavy", tail), F.concat(head, rest)))
    met = light.select("word", "n", F.explode(aims).alias("other")).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")).hint("merge"), "other")
    pairs = materialize(met.select("word", "n", "other", "other_n").distinct(), "pairs")
    back = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    each = pairs.unionByName(back).distinct().select("word", F.lit(1).cast("long").alias("k"), F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")).alias("x"))
    # A group holds at most one word for each character of the alphabet.
    alike = light.where("c is not null").select(F.concat(head, F.lit(_ANY), rest).alias("key"), F.struct((-F.col("n")).alias("n"), "word").alias("x"))
    groups = alike.groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("g")).where(F.size("g") > 1)
    member = groups.select("g", F.posexplode("g").alias("at", "own"))
    other = F.when(F.col("at") == 0, F.get("g", F.lit(1))).otherwise(F.get("g", F.lit(0)))
    merged = member.select("own.word", (F.size("g") - 1).cast("long").alias("k"), other.alias("x"))
    return each.unionByName(merged).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("x").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last, twice as far each round. A form's number is RATIO
    times its word's, so chains are logarithmic in the numbers, and the rounds in that."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(step.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of (word, n): form is the most frequent near word, if it is at
    least `ratio` times as frequent; root is the last of the forms of forms, or the word."""
    own = materialize(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    told = own.join(near_words(own).hint("merge"), "word", "left")
    has = F.coalesce(-F.col("best.n") >= F.col("n") * ratio, F.lit(False))
    told = materialize(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n")), "forms")
    roots = _roots(told.where("form is not null"))
    return told.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_report(docs: DataFrame) -> DataFrame:
    """The variants among the words of documents."""
    return variants(count_words(docs))
