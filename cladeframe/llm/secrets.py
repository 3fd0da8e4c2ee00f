"""Secret scan: fixed patterns, and a battery of randomness tests on long unbroken runs of characters.

A candidate is a maximal run of 20 or more of the characters that keys are written in. Its encoding is inferred as the
smallest alphabet that holds its characters. Four tests ask how far it is from uniform random text of that alphabet:
chi-squared uniformity over the symbols and over their kinds (case, digits; vowels where there is one case), the number
of runs of a kind, and the serial correlation of neighbouring symbols. Fisher's statistic joins them.

What is reported is what is controlled: the null hypothesis is that a candidate is ordinary writing. Its distribution
is measured, per shape (lower, upper, mixed case) and class of lengths, on runs that are ordinary by construction: every
document's own words, and the names of Python's library, written together as identifiers, slugs and paths are. A
candidate's p-value is the share of such runs that look at least as random. Benjamini and Hochberg's rule is applied
within each class of lengths, so short candidates, where the tests have little power, neither borrow from long ones nor
pass for want of evidence.

Cases: a null or empty text has no spans; repeated rows are scanned as rows of their own; a span of the base patterns
always stays; an added span that overlaps a base span is left out; candidates of one step of the statistic share one
decision; a run of mixed alphabets (+ or / with - or _, inner =) has no encoding and is left alone; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import builtins
import hashlib
import math
import random
import re
import sys
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORD = re.compile(r"[A-Za-z]{2,}")

#: Level of the false-discovery control.
LEVEL = 0.05
#: The joint statistic is cut into steps of 1 / GRID, STEPS of them: the control sees counts, not rows.
GRID, STEPS = 4, 400
#: Length classes: 20-27, 28-39, 40-63, 64-127, 128 and more.
LENGTHS = (28, 40, 64, 128)
SHAPES = ("lower", "upper", "mixed")
#: Ordinary runs made of library names, per length class.
NAMES = 1500

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_B64 = _UPPER + _LOWER + _DIGITS + "+/"
#: Smallest first; the last two are base 64 in both of its alphabets.
ALPHABETS = (
    _DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER, _LOWER, _UPPER + "234567", _LOWER + "234567", _DIGITS + _UPPER, _DIGITS + _LOWER,
    _UPPER + _LOWER, _UPPER + _LOWER + _DIGITS, _B64, _UPPER + _LOWER + _DIGITS + "-_",
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in code points, by start and then kind."""
    found = []
    if HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _chi2_sf(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution: closed form for even dof, recurrence from erfc for odd."""
    if x <= 0:
        return 1.0
    h = x / 2
    if h > 700:
        return 0.0
    if dof % 2 == 0:
        term, total = math.exp(-h), 0.0
        for k in range(dof // 2):
            total += term
            term *= h / (k + 1)
        return min(1.0, total)
    total = math.erfc(math.sqrt(h))
    term = math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for k in range(dof // 2):
        total += term
        term *= h / (k + 1.5)
    return min(1.0, total)


def encoding_of(run: str) -> str | None:
    """The smallest alphabet that holds the run's characters, padding aside."""
    seen = set(run.rstrip("="))
    return next((a for a in ALPHABETS if seen <= set(a)), None)


def shape_of(alphabet: str) -> int:
    lower, upper = "a" in alphabet, "A" in alphabet
    return 2 if lower and upper else 1 if upper else 0


@cache
def _tables(alphabet: str) -> tuple[dict[str, int], dict[str, int], list[float]]:
    """Code and kind of each symbol, and the kinds' shares of the alphabet."""
    mixed = shape_of(alphabet) == 2
    kind = {c: 2 if not c.isalpha() else (c.islower() if mixed else c in "aeiouAEIOU") + 0 for c in alphabet}
    tally = Counter(kind.values())
    return {c: k for k, c in enumerate(alphabet)}, kind, [tally[k] / len(alphabet) for k in range(3)]


def statistic(run: str, alphabet: str) -> float:
    """Fisher's statistic of the four tests: large if the run is far from uniform random text of the alphabet."""
    body = run.rstrip("=")
    place, kind, share = _tables(alphabet)
    n, size = len(body), len(alphabet)
    uniform = _chi2_sf(size / n * sum(c * c for c in Counter(body).values()) - n, size - 1)
    kinds = [kind[c] for c in body]
    tally = Counter(kinds)
    used = [k for k in range(3) if share[k]]
    mix = _chi2_sf(sum((tally[k] - n * share[k]) ** 2 / (n * share[k]) for k in used), len(used) - 1) if len(used) > 1 else 1.0
    s2, s3 = sum(s * s for s in share), sum(s**3 for s in share)
    mean, var = (n - 1) * s2, (n - 1) * (s2 - s2 * s2) + 2 * (n - 2) * (s3 - s2 * s2)
    same = sum(a == b for a, b in zip(kinds, kinds[1:]))
    runs = math.erfc(abs(same - mean) / math.sqrt(2 * max(var, 1e-9)))
    codes = [place[c] for c in body]
    mid = sum(codes) / n
    off = [c - mid for c in codes]
    spread = sum(c * c for c in off)
    serial = math.erfc(abs(sum(a * b for a, b in zip(off, off[1:])) / spread + 1 / n) * math.sqrt(n / 2)) if spread else 0.0
    return -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, mix, runs, serial))


def p_value(run: str, alphabet: str) -> float:
    """Chance that uniform random text of the alphabet looks at least as regular."""
    return _chi2_sf(statistic(run, alphabet), 8)


def step_of(x: float) -> int:
    return min(STEPS - 1, int(x * GRID))


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS)


def ordinary_runs(words: list[str], seed: int) -> Iterator[tuple[int, int, int]]:
    """(shape, length class, step) of one ordinary run per class, in a shape by the seed: words that follow each other,
    written together, some with separators, some with a number behind."""
    if not words:
        return
    rnd, shape = random.Random(seed), seed % len(SHAPES)
    bounds = [20, *LENGTHS, 2 * LENGTHS[-1]]
    for low, high in zip(bounds, bounds[1:]):
        n = rnd.randrange(low, high)
        tail = "".join(rnd.choices(_DIGITS, k=rnd.choice((0, 0, 1, 2, 4))))
        between = rnd.choice(("", "", "", "-", "_", "/")) if shape == 2 else ""
        at, parts, held = rnd.randrange(len(words)), [], 0
        while held < n:
            w = words[at % len(words)]
            parts.append(w.lower() if shape == 0 else w.upper() if shape == 1 else w.capitalize())
            held += len(w) + len(between)
            at += 1
        run = between.join(parts)[: n - len(tail)].rstrip(between or " ") + tail
        if alphabet := encoding_of(run):
            yield shape, length_class(n), step_of(statistic(run, alphabet))


def library_names() -> list[str]:
    """Words of the names that Python's own library uses, in order of their hashes."""
    names = {w for x in (*dir(builtins), *sys.stdlib_module_names, *dir(str), *dir(DataFrame)) for w in WORD.findall(x)}
    return sorted(names, key=lambda w: zlib.crc32(w.encode()))


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, shape, length class, step) of candidates with an inferred encoding that overlap no base span."""
    starts, ends = [], []  # the base spans as disjoint intervals
    for s, _, e in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        k = bisect_left(starts, b) - 1
        if (k < 0 or ends[k] <= a) and len(m[0].rstrip("=")) >= 20 and (alphabet := encoding_of(m[0])):
            out.append((a, b, shape_of(alphabet), length_class(b - a), step_of(statistic(m[0], alphabet))))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, base (spans), extra (candidates with shape, class and step), plain (the steps of its
    ordinary runs, as shape, class and step)."""
    i32 = pa.int32()
    spans = {"base": ("start", "kind", "end"), "extra": ("start", "end", "shape", "length_class", "step"), "plain": ("shape", "length_class", "step")}
    arrow = {k: pa.list_(pa.struct([(c, i32) for c in v])) for k, v in spans.items()}
    schema = "doc_id long, " + ", ".join(f"{k} array<struct<{','.join(f'{c}:int' for c in v)}>>" for k, v in spans.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {k: [] for k in spans}
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                said = {"base": base, "extra": added_spans(text, base), "plain": ordinary_runs(WORD.findall(text), zlib.crc32(text.encode("utf-8", "surrogatepass")))}
                for k, names in spans.items():
                    found[k].append([dict(zip(names, x)) for x in said[k]])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(found[k], arrow[k]) for k in spans]], names=["doc_id", *spans])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def cutoffs(candidates: dict[tuple[int, int, int], int], ordinary: dict[tuple[int, int, int], int], level: float = LEVEL) -> dict[tuple[int, int], int]:
    """Per shape and length class, how many of the lowest steps are discoveries, from counts by (shape, class, step)."""
    out = {(s, c): 0 for s in range(len(SHAPES)) for c in range(len(LENGTHS) + 1)}
    p = {}
    for s, c in out:
        seen, whole = 0, sum(ordinary.get((s, c, k), 0) for k in range(STEPS))
        for k in range(STEPS):
            seen += ordinary.get((s, c, k), 0)
            p[s, c, k] = (1 + seen) / (1 + whole)
    for c in range(len(LENGTHS) + 1):
        own = sorted((p[x], n) for x, n in candidates.items() if x[1] == c)
        m, seen, limit = sum(n for _, n in own), 0, 0.0
        for value, n in own:
            seen += n
            if value <= level * seen / m:
                limit = value
        for s in range(len(SHAPES)):
            out[s, c] = sum(p[s, c, k] <= limit for k in range(STEPS))
    return out


def secret_spans(docs: DataFrame, level: float = LEVEL) -> DataFrame:
    """doc_id, base and added spans as arrays of (start, kind, end); added ones have kind 3, "random"."""
    found = materialize(scan(docs), "spans")

    def tally(column: str) -> dict[tuple[int, int, int], int]:
        # At most len(SHAPES) * (len(LENGTHS) + 1) * STEPS rows come to the driver, whatever the input.
        x = found.select(F.explode(column).alias("x")).groupBy("x.shape", "x.length_class", "x.step").count()
        return {tuple(r)[:3]: r["count"] for r in x.collect()}

    names = library_names()
    ordinary = Counter(x for k in range(NAMES) for x in ordinary_runs(names, k))
    ordinary.update(tally("plain"))
    cut = cutoffs(tally("extra"), ordinary, level)
    limits = F.array(*[F.lit(cut[s, c]) for s in range(len(SHAPES)) for c in range(len(LENGTHS) + 1)])
    random_ = F.filter("extra", lambda x: x["step"] < F.element_at(limits, x["shape"] * (len(LENGTHS) + 1) + x["length_class"] + 1))
    as_spans = F.transform(random_, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", as_spans)).alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    names = F.array(*map(F.lit, (*KINDS, "random")))

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(kind: int):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return secret_spans(docs).select("doc_id", *map(number, range(len(KINDS))), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def base_digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
