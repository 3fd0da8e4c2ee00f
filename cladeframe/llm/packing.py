"""Best-fit packing of documents into token sequences of a fixed capacity.

The plan is made from the histogram of piece lengths, at most `capacity` numbers whatever the number of documents.
Bins that were filled alike are one entry of the plan, so a length's pieces take contiguous ranges of slots; each piece
finds its slot by its rank within its length.

Cases: a null or empty text is one piece that holds only the end id; a piece as long as the capacity fills a sequence
alone; equal lengths are ranked by (bucket, id, piece, checksum), and rows equal in all of these are interchangeable;
repeated rows are packed once per row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import kept_in_worker

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Ranks within a length are counted in hash buckets, so no task ranks a whole common length: as many buckets as the
#: pieces need to leave this number to each, 64 at least.
BUCKET_ROWS = 200_000


#: A word of these characters is lower-cased and cut by rule alone, as the tokenizer's own rules would.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class _Parts(dict):
    """Ids of an unbroken part as little-endian 32-bit numbers; at most `room` parts are remembered."""

    def __init__(self, encode, room: int = 700_000):
        super().__init__()
        self.encode, self.room = encode, room

    def __missing__(self, part: str) -> bytes:
        import numpy as np

        ids = np.asarray(self.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(part) <= 64 and len(self) < self.room:
            self[part] = ids
        return ids


class _Ids(dict):
    """Ids of a white-space separated word, put together from its parts' ids. One per Python worker and tokenizer."""

    def __init__(self, encode, room: int = 500_000):
        super().__init__()
        self.parts, self.room = _Parts(encode), room

    def __missing__(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:  # special tokens are cut before lower-casing
            ids = b"".join(map(self.parts.__getitem__, _PARTS.findall(word.lower())))
        else:
            ids = self.parts[word]
        if len(word) <= 64 and len(self) < self.room:
            self[word] = ids
        return ids


def known_ids(tokenizer: str) -> _Ids:
    return kept_in_worker(f"ids {tokenizer}", lambda: _Ids(_tokenizer(tokenizer).encode))


def _tokenizer(name: str):
    from tokenizers import Tokenizer

    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and the end id, cut where longer than the capacity.

    `ids` is binary, little-endian unsigned 32-bit. The tokenizer drops white space and never joins across it, so words
    are encoded one by one and remembered; a text with the separators U+001C to U+001F, which Python splits at and the
    tokenizer does not, is encoded whole.
    """
    schema = "doc_id long, piece int, start long, length long, ids binary"
    fields = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
    odd = "\x1c\x1d\x1e\x1f"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from cladeframe.llm.packing import known_ids  # the worker's own, kept from task to task

        known, last, step = known_ids(tokenizer), end_id.to_bytes(4, "little"), capacity * 4
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                parts = [text] if any(c in text for c in odd) else text.split()
                ids = b"".join(map(known.__getitem__, parts)) + last
                rows += [(doc_id, k, at // 4, len(ids[at : at + step]) // 4, ids[at : at + step]) for k, at in enumerate(range(0, len(ids), step))]
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, end rank, per sequence, first sequence, offset).

    A group is a contiguous run of sequences with equal contents. Each length splits at most one group and opens at most
    two, so there are under 3 * capacity groups; placing a length in a whole group leaves it less room than that length,
    so a group is taken O(log capacity) times.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # residuals that have groups, ascending
    out: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def leave(residual: int, first: int, n: int) -> None:
        if n and residual:
            if residual not in room:
                room[residual] = []
                bisect.insort(sizes, residual)
            room[residual].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                residual = sizes[at]
                first, n = room[residual].pop()
                if not room[residual]:
                    del room[residual]
                    sizes.pop(at)
            else:
                residual, first = capacity, made
                n = -(-left // (capacity // length))
                made += n
            each = residual // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, each, first, capacity - residual))
                leave(residual - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer than `each` are left: they share one sequence
                out.append((length, rank, rank + left, left, first + full, capacity - residual))
                leave(residual - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            leave(residual, first + full, n - full)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with `length` (1 to capacity) and whatever else they carry, plus `sequence_id` and `offset`."""
    spark = pieces.sparkSession
    kept = materialize(pieces, "pieces")
    buckets = max(64, kept.count() // BUCKET_ROWS)
    kept = kept.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = materialize(kept.groupBy("length", "_bucket").count(), "lengths")  # at most capacity * buckets rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(histogram, capacity), "_l long, _first long, _end long, _each long, _sequence long, _offset long"
    )
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = kept.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)))
    ranked = ranked.join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_before"))
    # The plan has O(capacity log capacity) rows (see plan): a proven bound for the broadcast.
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    nth = F.col("_rank") - F.col("_first")
    return placed.select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(nth, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of packed pieces that still carry `ids`; at most `capacity` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    held = packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("length"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return held.select("sequence_id", "length", joined.alias("ids"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, capacity, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, capacity, ("doc_id", "piece", "ids_crc32"))
