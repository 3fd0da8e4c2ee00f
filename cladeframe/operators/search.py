"""Field and text search: requests become Column predicates, and Spark plans the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

NUMERIC = ("int", "bigint", "double", "float", "smallint", "decimal")


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: object = None
    value2: object = None
    connector: str = "AND"


@dataclass(frozen=True)
class Group:
    """Conditions in parentheses; its connector is the first member's."""

    members: tuple


def leaf(df: DataFrame, c: Condition) -> Column | None:
    """One condition; None if it says nothing (no value, unknown operator)."""
    if c.column not in df.columns:
        raise ValueError(f"no such column: {c.column}")
    col, numeric = F.col(f"`{c.column}`"), dict(df.dtypes)[c.column].startswith(NUMERIC)
    if c.operator == "IS_EMPTY":
        return T.blank(col.cast("string"))
    if c.operator == "IS_NOT_EMPTY":
        return ~T.blank(col.cast("string"))
    if c.value is None or str(c.value).strip() == "":
        return None
    value, said = str(c.value).strip(), col.cast("string")
    number = col if numeric else T.lenient_double(col)
    if c.operator in ("EQUALS", "NOT_EQUALS"):
        same = T.fold(said) == T.fold_text(value)
        return same if c.operator == "EQUALS" else ~same
    if c.operator in ("LIKE", "NOT_LIKE"):
        held = T.like_anywhere(said, value)
        return held if c.operator == "LIKE" else ~held
    if c.operator == "STARTS_WITH":
        return T.like_anywhere(said, value, head=True)
    if c.operator == "ENDS_WITH":
        return T.like_anywhere(said, value, tail=True)
    if c.operator == "GREATER_THAN":
        return number > float(value)
    if c.operator == "LESS_THAN":
        return number < float(value)
    if c.operator == "BETWEEN" and c.value2 not in (None, ""):
        low, high = sorted((float(value), float(c.value2)))
        return number.between(low, high)
    return None


def predicate(df: DataFrame, conditions) -> Column | None:
    """The tree of a flat list: NOT binds tightest, then AND, then OR; None if nothing is left."""
    ors: list[Column] = []
    for c in conditions:
        own = predicate(df, c.members) if isinstance(c, Group) else leaf(df, c)
        if own is None:
            continue
        head = c.members[0].connector if isinstance(c, Group) else c.connector
        own = ~own if head == "NOT" else own
        if ors and head != "OR":
            ors[-1] = ors[-1] & own
        else:
            ors.append(own)
    out = None
    for x in ors:
        out = x if out is None else out | x
    return out


def search(df: DataFrame, conditions) -> DataFrame:
    p = predicate(df, conditions)
    if p is None:
        raise ValueError("no complete condition")
    return df.where(p)


def page(df: DataFrame, sort: str, rid: str, number: int = 1, size: int = 100, descending: bool = False) -> DataFrame:
    """One page by folded text or number; ties by id in the same direction. Spark keeps only the top rows per task."""
    key = F.col(sort) if dict(df.dtypes)[sort].startswith(NUMERIC) else T.fold(F.col(sort))
    by = [key.desc(), F.col(rid).desc()] if descending else [key.asc(), F.col(rid).asc()]
    return df.orderBy(*by).offset((number - 1) * size).limit(size)


def text_query(query: str):
    """Nested tuples of a text query: ("and", a, b), ("or", a, b), ("not", a, b) or a phrase.

    Quotes keep phrases; neighbours are joined by an implicit AND that binds tightest, then NOT, AND, OR; commas and
    semicolons separate; an operator with nothing to join is a word."""
    out, k, words = [], 0, query.replace(",", " ").replace(";", " ")
    while k < len(words):
        ch = words[k]
        if ch == '"':
            end = words.find('"', k + 1)
            end = len(words) if end < 0 else end
            if words[k + 1 : end].strip():
                out.append(("word", words[k + 1 : end].strip()))
            k = end + 1
        elif ch in "()":
            out.append((ch, ch))
            k += 1
        elif ch.isspace():
            k += 1
        else:
            end = k
            while end < len(words) and not words[end].isspace() and words[end] not in '"()':
                end += 1
            w = words[k:end]
            out.append(("op" if w in ("AND", "OR", "NOT") else "word", w))
            k = end
    if sum((t == "(") - (t == ")") for t, _ in out):  # unbalanced
        out = [x for x in out if x[0] not in "()"]
    clean: list[tuple[str, str]] = []
    for j, (t, w) in enumerate(out):
        after = out[j + 1][0] if j + 1 < len(out) else None
        if t == "op" and w == "AND" and j + 1 < len(out) and out[j + 1] == ("op", "NOT"):
            continue
        dangling = t == "op" and (not clean or clean[-1][0] in ("op", "(") or after in (None, ")"))
        clean.append(("word", w) if dangling else (t, w))
    pos = 0

    def peek():
        return clean[pos] if pos < len(clean) else (None, None)

    def item():
        nonlocal pos
        t, w = peek()
        pos += 1
        if t == "(":
            inside = level(0)
            if peek()[0] == ")":
                pos += 1
            return inside
        return w if t == "word" else None

    def run():
        left = item()
        while peek()[0] in ("word", "("):
            right = item()
            left = right if left is None else left if right is None else ("and", left, right)
        return left

    def level(n: int):
        nonlocal pos
        ops = ("OR", "AND", "NOT")
        if n == 3:
            return run()
        left = level(n + 1)
        while peek() == ("op", ops[n]):
            pos += 1
            right = level(n + 1)
            left = right if left is None else left if right is None else (ops[n].lower(), left, right)
        return left

    return level(0)


def text_predicate(columns: list[str], tree, case_sensitive: bool = False) -> Column:
    """A phrase holds if any one column has it as a substring; phrases under three characters match nothing."""
    if isinstance(tree, str):
        if len(tree) < 3:
            return F.lit(False)
        low = (lambda c: c) if case_sensitive else F.lower
        hits = [F.coalesce(low(F.col(c)).contains(tree if case_sensitive else tree.lower()), F.lit(False)) for c in columns]
        out = hits[0]
        for h in hits[1:]:
            out = out | h
        return out
    op, a, b = tree
    left, right = text_predicate(columns, a, case_sensitive), text_predicate(columns, b, case_sensitive)
    return left & right if op == "and" else left | right if op == "or" else left & ~right
