"""Fill-in-the-middle: each text is cut in prefix, middle and suffix, which are put in another order behind markers.

The cuts of a whole Arrow batch are found at once in its UTF-8 bytes. A table gives each byte a class; a byte begins a
unit if the classes of the byte before and its own say so (UNITS), as does the first byte of each text. A running count
of beginnings, less its value where the text begins, counts units within each text; a search in it for the wanted counts
gives the byte positions of all cuts. The three parts of all rows then lie in the batch's own buffer, between new offsets.

Where to cut, and which form, hang on the sha256 of seed and id alone: reruns and moved rows get the same.

Cases: a null text is empty, and an empty one plain, as is one that holds a marker; a null id hashes as an empty one; rows
that are equal in id and text get equal results; a text of any length is cut whole (a batch is taken in pieces of some
megabytes, a longer text alone); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKERS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many stay plain; of a hundred others so many have the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
AT_ONCE = 8 << 20  # bytes of text

#: Classes of bytes: 0 the later bytes of a code point, 1 white space, 2 a line's end, 3 all others.
CLASSES = np.full(256, 3, np.uint8)
CLASSES[0x80:0xC0] = 0
CLASSES[[0x20, *range(0x09, 0x0E)]] = 1
CLASSES[0x0A] = 2
#: By the class of the byte before and of the byte itself: whether it begins a unit.
UNITS = {unit: np.zeros((4, 4), bool) for unit in ("char", "word", "line")}
UNITS["char"][:, 1:] = True
UNITS["word"][1:3, 3] = True
UNITS["line"][2, 1:] = True


def cuts(data: np.ndarray, offsets: np.ndarray, draws: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Units of each text, and two byte positions in it, in order, for the draws (two a text) modulo units + 1.

    data: bytes; offsets: where the texts begin in them, and the end of the last.
    """
    begin, end = offsets[:-1], offsets[1:]
    classes = CLASSES[data]
    starts = np.empty(len(data), bool)
    starts[1:] = UNITS[unit][classes[:-1], classes[1:]]
    starts[begin[begin < end]] = True
    count = np.cumsum(starts, dtype=np.int64)
    to = np.concatenate([[0], count])
    n = to[end] - to[begin]
    k = np.sort(draws % (n[:, None] + 1).astype(np.uint64), axis=1).astype(np.int64)
    at = np.searchsorted(count, to[begin][:, None] + k + 1)  # where unit k (from 0) begins: the first byte that so many starts reach
    return n, np.where(k == n[:, None], end[:, None], at)


def _code_points(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    to = np.concatenate([[0], np.cumsum(CLASSES[data] != 0, dtype=np.int64)])
    return to[end] - to[begin]


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most AT_ONCE bytes, or one row."""
    marks = [0]
    while marks[-1] < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[marks[-1]] + AT_ONCE, "right")) - 1
        marks.append(max(last, marks[-1] + 1))
    yield from pairwise(marks)


def three_parts(docs: DataFrame, unit: str = "char", seed: str = "1", markers: tuple[str, str, str] = MARKERS, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, prefix_chars, middle_chars): n is the number of units; form is plain, psm or
    spm; a plain text is all prefix, and its numbers of code points are null."""
    text = F.coalesce("text", F.lit("")).alias("text")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    held = F.lit(False)
    for m in markers:
        held |= F.col("text").contains(m)
    form = F.when((F.col("text") == "") | held | (h[2] % 100 >= 100 - plain), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select("doc_id", text, digest.alias("digest")).select("doc_id", "text", form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, forms = b.column(1), b.column(2)
            _, where, held = texts.buffers()
            offsets = np.frombuffer(where, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            draws = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (3, 4)], axis=1).astype(np.uint64)
            for lo, hi in _pieces(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                data = np.frombuffer(held, np.uint8, own[-1], offsets[lo]) if own[-1] else np.zeros(0, np.uint8)
                n, at = cuts(data, own, draws[lo:hi], unit)
                is_plain = forms.slice(lo, hi - lo).to_numpy(zero_copy_only=False) == "plain"
                at[is_plain] = own[1:][is_plain, None]
                chars = [pa.array(_code_points(data, x, y), pa.int64(), mask=is_plain) for x, y in ((own[:-1], at[:, 0]), (at[:, 0], at[:, 1]))]
                ends = np.concatenate([[0], np.column_stack([at, own[1:]]).ravel()]).astype(np.int32)
                parts = pa.StringArray.from_buffers(3 * (hi - lo), pa.py_buffer(ends), pa.py_buffer(data))
                third = [parts.take(pa.array(np.arange(k, len(parts), 3))) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(n), forms.slice(lo, hi - lo), *third, *chars],
                    names=["doc_id", "n", "form", "prefix", "middle", "suffix", "prefix_chars", "middle_chars"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix string, middle string, suffix string, prefix_chars long, middle_chars long")


def fill_in_middle(docs: DataFrame, markers: tuple[str, str, str] = MARKERS, **how) -> DataFrame:
    """three_parts' columns (see there for `how`), and output: the text in its new order, with markers."""
    p, s, m = (F.lit(x) for x in markers)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "plain", F.col("prefix")).when(F.col("form") == "psm", psm).otherwise(spm)
    return three_parts(docs, markers=markers, **how).withColumn("output", output)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of. No text that is cut holds a marker, and none can arise at a seam, as long as
    markers begin with a character that they do not hold again."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in markers), -1)
    first, second, middle = (F.get(parts, k) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def infilling_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the hashes of the output and of the text read back from it."""
    made = fill_in_middle(docs)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
