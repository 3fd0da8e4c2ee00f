"""Scoring texts with a probabilistic suffix tree.

Symbols are words that make up at least SHARE of all training tokens; every other word is spelled by its class, the last
two bytes of the word, and its own share of that class. A state is a context of 1 to DEPTH symbols that diverges from
its suffix; its distribution is its counts, discounted, with the rest of its mass spread as its suffix's distribution;
the longest suffix of the history that is a state gives a symbol's probability.

Frequent contexts (all of one symbol, and longer ones with CONTEXT_SHARE of the positions) are tested by likelihood
ratio on tables of counts, and kept in memory: at most 1 / SHARE symbols and classes, 1 / CONTEXT_SHARE contexts and
1 / ENTRY entries of each depth, all shares of the training tokens, so that these broadcasts are bounded whatever the
input. Every other context, down to two occurrences, is tested where its positions meet: positions are dealt into
buckets by their last two symbols (three, where those two are frequent), as many as leave BUCKET positions to each. A
context is a state there if, each of its occurrences left out in turn, it foretells what follows better than its suffix
by GAIN nats in all. So the tree grows with the corpus, and no context there holds more than CONTEXT_SHARE of it.

Counts of rare words are joined by shuffle, on the words themselves; none is hot by definition, and each document sends
a word once.

Cases: a null or empty text is its end token; a null id is held out (its text form is empty); repeated rows are scored
as rows of their own; an empty training set gives unseen-word scores; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import spread_join

SHARE, CONTEXT_SHARE, KNOWN, ENTRY = 1e-4, 2e-5, 1e-6, 1e-6
DEPTH = 3
ADD, DISCOUNT = 0.1, 0.75
GAIN = 2.0
BUCKET = 200_000
#: Texts whose sums are put together in one part.
PART = 50_000
#: Longer contexts with fewer occurrences than this are never taken for frequent.
FEWEST = 64
END = b""
_FLUSH = 600_000
_HELD = 4_000_000
_BITS = 15
_NONE = (1 << _BITS) - 1  # no third symbol before: the text starts there


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words, then the end."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found.append(END)
    return found


def count_words(train: DataFrame) -> DataFrame:
    """(word, c) over all texts of train; partial counts leave a task when their table is full."""
    names, kinds = ["word", "c"], [pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(tokens(t.as_py()))
                if len(seen) > _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((seen.keys(), seen.values()), kinds)], names=names)
                    seen = Counter()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip((seen.keys(), seen.values()), kinds)], names=names)

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Words:
    """What encoding needs: symbols, classes and counts of known words, all bounded (see the module)."""

    def __init__(self):
        self.symbol: dict[bytes, int] = {}  # frequent words
        self.klass: dict[bytes, int] = {}  # last two bytes
        self.known: dict[bytes, int] = {}  # counts of words of at least KNOWN
        self.spelled = np.zeros(0)  # log10 of a class's denominator; 0 for words
        self.number: dict[bytes, int] = {}
        self.code = self.log = np.zeros(1)

    def index(self) -> None:
        """Known words by number, with their symbols and the logs of their counts; the last entry is for all others."""
        self.number = {w: k for k, w in enumerate(self.known)}
        self.code = np.array([self.symbol.get(w, self.klass.get(w[-2:], 1)) for w in self.known] + [1], np.int64)
        self.log = np.append(np.log10(np.array(list(self.known.values()), float) + ADD), 0.0)

    def coded(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Per token of all texts: word number (-1: not known) and symbol; ends of the texts; the words not known."""
        words: list[bytes] = []
        ends = []
        for t in texts:
            words += tokens(t)
            ends.append(len(words))
        number = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        codes = self.code[number]
        odd = np.flatnonzero(number < 0)
        other, klass = [words[k] for k in odd.tolist()], self.klass
        codes[odd] = [klass.get(w[-2:], 1) for w in other]
        return number, codes, np.array(ends, np.int64), other


def shifted(codes: np.ndarray, back: int) -> np.ndarray:
    """The symbol `back` places before each; before the first, an end."""
    return np.concatenate([np.zeros(min(back, len(codes)), np.int64), codes[: max(0, len(codes) - back)]])


def places(ends: np.ndarray) -> np.ndarray:
    """Each token's place in its text."""
    start = np.concatenate([[0], ends[:-1]])
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(start, ends - start)


def among(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array `of`."""
    return of[np.minimum(np.searchsorted(of, keys), len(of) - 1)] == keys if len(of) else np.zeros(len(keys), bool)


class Model:
    """The tree's frequent states; all parts are bounded (see the module). Symbols: 0 end, 1 other words, then classes
    and words. A context's key has its latest symbol in the lowest place."""

    def __init__(self):
        self.size = 2
        self.first = np.zeros(0)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # contexts, rest, entries, gain
        self.frequent: list[np.ndarray] = []  # contexts of two symbols, of three

    def key(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """Keys of the `depth` symbols before each position."""
        return sum(shifted(codes, back) * self.size ** (back - 1) for back in range(1, depth + 1))

    def p(self, before: list[np.ndarray], has: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        """Probability of x by the longest frequent state of the symbols before, the latest first."""
        p, key = self.first[x], np.zeros(len(x), np.int64)
        for depth, (contexts, rest, entries, gain) in enumerate(self.levels, 1):
            key = key + before[depth - 1] * self.size ** (depth - 1)
            if not len(contexts):
                continue
            hit = np.flatnonzero(has[depth - 1] & among(key, contexts))
            at = np.searchsorted(contexts, key[hit])
            more = np.zeros(len(hit))
            if len(entries):
                full = key[hit] * self.size + x[hit]
                e = np.minimum(np.searchsorted(entries, full), len(entries) - 1)
                more = np.where(entries[e] == full, gain[e], 0.0)
            p[hit] = rest[at] * p[hit] + more
        return p

    def log10(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol by its longest frequent state."""
        at = places(ends)
        return np.log10(self.p([shifted(codes, k) for k in range(1, DEPTH + 1)], [at >= k for k in range(DEPTH)], codes))


def chunks(batches: Iterator[pa.RecordBatch], column: str, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of some rows each, with all symbols of the binary column and their texts' ends."""
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            b = whole.slice(lo, rows)
            parts = [np.frombuffer(x.as_py(), np.uint16) for x in b.column(column)]
            yield b, np.concatenate(parts).astype(np.int64), np.cumsum([len(p) for p in parts])


def count_contexts(coded: DataFrame, model: Model, depth: int, allowed: np.ndarray | None) -> DataFrame:
    """(key, c): counts of (context of `depth` symbols, next symbol), for the allowed contexts (None: all)."""
    shared = coded.sparkSession.sparkContext.broadcast((model, allowed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, only = shared.value
        keys, counts, held = [], [], 0

        def merged():
            k, inv = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(inv, np.concatenate(counts), len(k)).astype(np.int64)

        for _, codes, ends in chunks(batches, "codes"):
            key, has = model.key(codes, depth), places(ends) >= depth - 1
            if only is not None:
                has &= among(key, only)
            k, c = np.unique(key[has] * model.size + codes[has], return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > 4 * _FLUSH:
                k, c = merged()
                keys, counts, held = [k], [c], len(k)
                if held > 3 * _FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["key", "c"])
                    keys, counts, held = [], [], 0
        if held:
            k, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["key", "c"])

    return coded.select("codes").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def symbols(vocabulary: DataFrame, n: int) -> tuple[Words, Model]:
    """The alphabet of n training tokens with the counts in `vocabulary`, and a model without contexts."""
    words, model = Words(), Model()
    low = max(n * SHARE, 1)
    words.known = {bytes(r["word"]): r["c"] for r in vocabulary.where(F.col("c") >= max(n * KNOWN, 2)).toLocalIterator()}
    frequent = sorted(w for w, c in words.known.items() if c >= low and w != END)
    tail = F.expr("substring(word, greatest(length(word) - 1, 1), 2)")
    other = vocabulary.where((F.col("c") < low) | (F.col("c") < 2)).where(F.length("word") > 0)
    klasses = materialize(other.groupBy(tail.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")), "classes")
    big = sorted((bytes(r["k"]), r["c"], r["v"]) for r in klasses.where(F.col("c") >= low).collect())
    every = klasses.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    words.klass = {k: 2 + j for j, (k, _, _) in enumerate(big)}
    words.symbol = {w: 2 + len(big) + j for j, w in enumerate(frequent)} | {END: 0}
    model.size = 2 + len(big) + len(frequent)
    rest = (every["c"] - sum(c for _, c, _ in big), every["v"] - sum(v for _, _, v in big))
    counts = np.zeros(model.size)
    counts[0], counts[1] = words.known.get(END, 0), rest[0]
    words.spelled = np.zeros(model.size)
    words.spelled[1] = np.log10(rest[0] + ADD * (rest[1] + 1))
    for j, (_, c, v) in enumerate(big):
        counts[2 + j], words.spelled[2 + j] = c, np.log10(c + ADD * (v + 1))
    for w in frequent:
        counts[words.symbol[w]] = words.known[w]
    words.index()
    model.first, model.counts = (counts + ADD) / (counts.sum() + ADD * model.size), counts
    return words, model


def encode(rows: DataFrame, words: Words) -> DataFrame:
    """Per row: uid, doc_id, held_out, n_tokens, known (tokens of known words), base (log10 of their counts), spelled
    (log10 of words in their classes), codes (the symbols, 16 bits each), rare (the other words, with their counts)."""
    shared = rows.sparkSession.sparkContext.broadcast(words)
    pair = pa.list_(pa.struct([("w", pa.binary()), ("c", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                number, codes, ends, other = m.coded(part.column(1).to_pylist())
                starts = np.concatenate([[0], ends[:-1]])
                seen, logs, denominator = number >= 0, m.log[number], m.spelled[codes]
                known = np.add.reduceat(seen.astype(np.int64), starts)
                # A word spelled by its class also takes its own count; counts of other words are added after the join.
                spelled = np.where((denominator != 0) & seen, logs, 0.0) - denominator
                small, at, rare = codes.astype(np.uint16), 0, []
                for n in (ends - starts - known).tolist():
                    rare.append([{"w": w, "c": c} for w, c in Counter(other[at : at + n]).items()])
                    at += n
                ids = np.arange(uid, uid + part.num_rows)
                uid += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids), part.column(0), part.column(2), pa.array(ends - starts), pa.array(known), pa.array(np.add.reduceat(logs, starts)),
                        pa.array(np.add.reduceat(spelled, starts)), pa.array([small[a:e].tobytes() for a, e in zip(starts, ends)], pa.binary()), pa.array(rare, pair),
                    ],
                    names=["uid", "doc_id", "held_out", "n_tokens", "known", "base", "spelled", "codes", "rare"],
                )

    return rows.mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, spelled double, codes binary, rare array<struct<w:binary,c:long>>")


def learn(coded: DataFrame, model: Model, n: int) -> Model:
    """Adds the frequent states over the n tokens of the coded training texts."""
    spark, allowed, size = coded.sparkSession, None, model.size
    low = max(n * CONTEXT_SHARE, FEWEST)
    parents = spark.createDataFrame([(0, k, int(c), int(model.counts.sum())) for k, c in enumerate(model.counts)], "s long, x long, c long, n long")
    for depth in range(1, DEPTH + 1):
        found = materialize(count_contexts(coded, model, depth, allowed), f"contexts{depth}")
        split = found.select(F.expr(f"key div {size}").alias("s"), F.expr(f"key % {size}").alias("x"), "c")
        totals = materialize(split.groupBy("s").agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), F.count("*").alias("n_")), "totals")
        split = materialize(spread_join(split, totals, ["s"], F.col("x")), f"shares{depth}")
        suffix = F.expr(f"s % {size ** (depth - 1)}")
        rows = split.withColumn("up", suffix).join(parents.select(F.col("s").alias("up"), "x", F.col("c").alias("pc"), F.col("n").alias("pn")), ["up", "x"])
        gain = 2 * F.sum(F.col("c") * F.log((F.col("c") / F.col("n")) / (F.col("pc") / F.col("pn"))))
        tested = rows.groupBy("s").agg(gain.alias("g"), F.first("n").alias("n"), F.first("kinds").alias("kinds"))
        free = F.greatest(F.col("kinds") - 1, F.lit(1))
        states = materialize(tested.where(F.col("g") > free + 4 * F.sqrt(2.0 * free)).select("s", "n"), f"states{depth}")
        kept = split.where(F.col("c") >= max(2, ENTRY * n)).join(states.select("s"), "s").select("s", "x", "c", "n").toPandas().sort_values(["s", "x"])
        own = states.toPandas().sort_values("s")
        share = ((kept["c"] - DISCOUNT) / kept["n"]).to_numpy(float)
        contexts = own["s"].to_numpy(np.int64)
        mass = np.bincount(np.searchsorted(contexts, kept["s"].to_numpy(np.int64)), share, len(contexts)) if len(kept) else np.zeros(len(contexts))
        model.levels.append((contexts, 1 - mass, (kept["s"] * size + kept["x"]).to_numpy(np.int64), share))
        if depth < DEPTH:
            longer = split.where(F.col("c") >= low).select((F.col("s") * size + F.col("x")).alias("k")).toPandas()["k"].to_numpy(np.int64)
            allowed, parents = np.sort(longer), split
            model.frequent.append(allowed)
    return model


def positions(coded: DataFrame, model: Model, buckets: int) -> DataFrame:
    """(bucket, n, v, u): n positions of a bucket. v packs symbols and whether the text is held out, the last symbol
    highest, sorted; u is the text's uid. Bytes of one place are kept together and compressed."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        hot2, hot3 = m.frequent
        vs, bs, us, held = [], [], [], 0

        def flush():
            v, b, u = np.concatenate(vs), np.concatenate(bs), np.concatenate(us)
            order = np.lexsort((v, b))
            v, b, u = v[order], b[order], u[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
            rows = [(int(b[a]), int(e - a), packed(v[a:e]), packed(u[a:e])) for a, e in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            names, kinds = ["bucket", "n", "v", "u"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch, codes, ends in chunks(batches, "codes"):
            uid = batch.column("uid").to_numpy()
            if held >= _HELD:
                yield flush()
                vs, bs, us, held = [], [], [], 0
            owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            at, c1, c2, c3 = places(ends), shifted(codes, 1), shifted(codes, 2), shifted(codes, 3)
            pair = c2 * m.size + c1
            far = at >= 2
            open_ = np.flatnonzero((at >= 1) & ~(far & among(c3 * m.size**2 + pair, hot3)))
            c1, c2, pair, x = c1[open_], c2[open_], pair[open_], codes[open_]
            c3 = np.where(far[open_], c3[open_], _NONE)
            v = (((c1 << _BITS | c2) << _BITS | c3) << _BITS | x) << 1 | batch.column("held_out").to_numpy(zero_copy_only=False)[owner[open_]]
            mix = (pair * (_NONE + 1) + np.where(among(pair, hot2), c3 + 1, 0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            vs.append(v)
            bs.append(((mix >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64))
            us.append(uid[owner[open_]])
            held += len(v)
        if held:
            yield flush()

    return coded.select("uid", "held_out", "codes").mapInArrow(run, "bucket long, n long, v binary, u binary")


def packed(a: np.ndarray) -> bytes:
    return pa.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def refined(group: np.ndarray, x_count: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probabilities of rows (context, symbol) with these training counts, given those of the context's suffix: where
    the context is a state, its own; elsewhere p as it is. Rows of a context are neighbours."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(group))))
    n, kinds = np.add.reduceat(x_count, start)[of], np.add.reduceat((x_count > 0).astype(np.int64), start)[of]
    with np.errstate(divide="ignore", invalid="ignore"):
        own = np.maximum(x_count - DISCOUNT, 0) / n + DISCOUNT * kinds / n * p
        # One occurrence left out: a symbol seen once is then new to the context.
        less = np.maximum(x_count - 1 - DISCOUNT, 0) / (n - 1) + DISCOUNT * (kinds - (x_count == 1)) / (n - 1) * p
        gain = np.where((x_count > 0) & (n > 1), x_count * np.log(np.maximum(less, 1e-12) / p), 0.0)
    state = (np.add.reduceat(gain, start) >= GAIN)[of] & (n > 1)
    return np.where(state, own, p)


def deepen(v: np.ndarray, model: Model) -> np.ndarray:
    """For positions packed as in `positions`: log10 of how much more likely each symbol is by its longest state than by
    its longest frequent state."""
    hot2, _ = model.frequent
    rows, back = np.unique(v >> 1, return_inverse=True)
    count = np.bincount(back, 1 - (v & 1), len(rows))
    c1, c2, c3, x = (rows >> _BITS * k & _NONE for k in (3, 2, 1, 0))
    far = c3 != _NONE
    p0 = model.p([c1, c2, np.where(far, c3, 0)], [np.ones(len(rows), bool), np.ones(len(rows), bool), far], x)
    # Contexts of two symbols: their rows, whatever stands before; those that are frequent are no business of a bucket.
    pair = rows >> 2 * _BITS
    two, at = np.unique(pair << _BITS | x, return_inverse=True)
    own = np.bincount(at, count, len(two))
    first = np.zeros(len(two), np.int64)
    first[at] = np.arange(len(rows))
    p2 = refined(two >> _BITS, own, p0[first])[at]
    p2 = np.where(among(c2 * model.size + c1, hot2), p0, p2)
    return np.log10(refined(rows >> _BITS, count, p2) / p0)[back]


def rarer_states(coded: DataFrame, model: Model, n: int) -> DataFrame:
    """(uid, deep): what the states that are not frequent add to each text's score.

    A task sums what its buckets add to each text, and sends the sums packed, one row for each part of the texts; so rows
    are as many as the pieces of a shuffle, however many texts a task meets. The parts are then summed one pack at a time.
    """
    dealt = positions(coded, model, max(8, n // BUCKET))
    shared = coded.sparkSession.sparkContext.broadcast(model)
    parts = max(8, coded.count() // PART)

    def merged(sums: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        own, at = np.unique(np.concatenate([x for x, _ in sums]), return_inverse=True)
        return own, np.bincount(at, np.concatenate([y for _, y in sums]), len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, v, u, sums, held = None, [], [], [], 0

        def close():
            more = deepen(np.concatenate(v), shared.value)
            some = np.flatnonzero(more)
            sums.append((np.concatenate(u)[some], more[some]))
            v.clear()
            u.clear()

        def packs() -> pa.RecordBatch:
            own, more = merged(sums)
            mix = own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            part = ((mix >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, own, more = part[order], own[order], more[order]
            start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
            ends = np.append(start[1:], len(part)) if len(part) else start
            return pa.RecordBatch.from_arrays(
                [pa.array(part[start]), pa.array(ends - start), pa.array([packed(own[x:y]) for x, y in zip(start, ends)], pa.binary()), pa.array([packed(more[x:y]) for x, y in zip(start, ends)], pa.binary())],
                names=["part", "n", "u", "more"],
            )

        for batch in batches:
            for k in range(batch.num_rows):
                bucket, n = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if v and bucket != now:
                    close()
                    held += len(sums[-1][0])
                    if held > _HELD:
                        sums = [merged(sums)]
                        held = len(sums[0][0])
                        if held > _HELD // 2:
                            yield packs()
                            sums, held = [], 0
                now = bucket
                v.append(unpacked(batch.column(2)[k].as_py(), n, np.int64))
                u.append(unpacked(batch.column(3)[k].as_py(), n, np.int64))
        if v:
            close()
        if sums:
            yield packs()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, held = None, [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                part, n = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if sums and part != now:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(sums)], names=["uid", "deep"])
                    sums, held = [], 0
                now = part
                sums.append((unpacked(batch.column(2)[k].as_py(), n, np.int64), unpacked(batch.column(3)[k].as_py(), n, np.float64)))
                held += n
                if held > _HELD:
                    sums = [merged(sums)]
                    held = 0
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged(sums)], names=["uid", "deep"])

    # A task's buckets follow each other, so that a text gets one sum from each task, whatever the number of buckets.
    summed = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "part long, n long, u binary, more binary")
    return summed.repartition("part").sortWithinPartitions("part").mapInArrow(total, "uid long, deep double")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id").cast("long")).alias("held_out"))
    vocabulary = materialize(count_words(rows.where("not held_out")), "vocabulary")
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = sums["n"], sums["v"]
    words, model = symbols(vocabulary, n)
    coded = materialize(encode(rows, words), "coded")
    model = learn(coded.where("not held_out"), model, n)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, codes, ends in chunks(batches, "codes"):
            logs = np.add.reduceat(shared.value.log10(codes, ends), np.concatenate([[0], ends[:-1]]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(logs)], names=[*b.schema.names[1:], "tree"])

    kept = ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "spelled"]
    tree = coded.select("codes", *kept).mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, spelled double, tree double")
    deep = rarer_states(coded, model, n)
    counts = vocabulary.where(F.col("c") < max(n * KNOWN, 2)).select(F.col("word").alias("w"), F.col("c").alias("in_training"))
    each = coded.where(F.size("rare") > 0).select("uid", F.explode("rare").alias("x")).select("uid", "x.w", "x.c")
    own = F.coalesce("in_training", F.lit(0))
    joined = each.join(counts, "w", "left")
    found = joined.groupBy("uid").agg(F.sum(F.col("c") * F.log10(own + ADD)).alias("more"), F.sum(F.when(own > 0, F.col("c")).otherwise(0)).alias("seen"))
    whole = tree.join(found, "uid", "left").join(deep, "uid", "left")
    more, none = F.coalesce("more", F.lit(0.0)), F.lit(0.0)
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * float(np.log10(n + ADD * (v + 1)))).alias("base_score"),
        (F.col("tree") + F.col("spelled") + more + F.coalesce("deep", none)).alias("score"),
    )
