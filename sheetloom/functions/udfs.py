"""Arrow functions for what needs grammar. A worker remembers what each was asked, over all batches
of a task, since a corpus asks for few distinct declarations and selectors very often."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import selectors as S
from .properties import one_name, overlap
from .values import declaration_key, one_value


def _over(kind: str, f: Callable) -> Callable[..., Column]:
    """A pandas UDF that calls f once for each distinct row of its arguments; null gives null."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        remembered = lru_cache(1 << 16)(f)
        for args in batches:
            rows = zip(*(args[c].tolist() for c in args.columns), strict=True)
            yield pd.Series([None if any(x is None for x in row) else remembered(*row) for row in rows], dtype=object)

    return lambda *columns: run(F.struct(*(c.alias(f"a{k}") for k, c in enumerate(columns))))


def normalized_property(prop: Column, aggressive: bool = False) -> Column:
    return _over("string", lambda p: one_name(p, aggressive))(prop)


def normalized_value(prop: Column, value: Column, aggressive: bool = False) -> Column:
    return _over("string", lambda p, v: one_value(p, v, aggressive))(prop, value)


def key_of(prop: Column, value: Column, important: Column, aggressive: bool = False) -> Column:
    return _over("string", lambda p, v, i: declaration_key(p, v, bool(i), aggressive))(prop, value, important)


def split_selectors(text: Column) -> Column:
    return _over("array<string>", S.split_list)(text)


def selector_list_key(text: Column) -> Column:
    return _over("string", S.list_key)(text)


def spaced_comma(text: Column) -> Column:
    return _over("boolean", S.spaced_comma)(text)


def unescaped(text: Column) -> Column:
    return _over("string", S.unescape)(text)


def subject(selector: Column) -> Column:
    """struct(type, classes, ids) of the last compound; null where it cannot be read."""

    def identity(s: str) -> dict | None:
        p = S.parsed(s)
        return {"type": p.kind, "classes": sorted(p.classes), "ids": sorted(p.ids)} if p.readable else None

    @F.pandas_udf("type string, classes array<string>, ids array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [identity(t) if t is not None else None for t in texts]
        return pd.DataFrame([f or {"type": None, "classes": None, "ids": None} for f in found], columns=["type", "classes", "ids"])

    return run(selector)


def attributes(selector: Column) -> Column:
    """The attribute selectors in order, as strings name op value flag, and whether each binds."""
    return _over("array<struct<name: string, op: string, value: string, flag: string, binds: boolean>>", lambda s: [vars(a) for a in S.parsed(s).attributes])(selector)


def mutually_exclusive(a: Column, b: Column) -> Column:
    return _over("boolean", S.exclusive)(a, b)


def likely_disjoint(a: Column, b: Column) -> Column:
    return _over("boolean", S.likely_apart)(a, b)


def all_apart(a: Column, b: Column, aggressive: bool = False) -> Column:
    """Is every selector of one array apart from every one of the other?"""

    def every(x: str, y: str) -> bool:
        return all(aggressive and S.likely_apart(m, n) or S.exclusive(m, n) for m in json.loads(x) for n in json.loads(y))

    return _over("boolean", every)(F.to_json(a), F.to_json(b))


def properties_overlap(a: Column, b: Column) -> Column:
    return _over("boolean", overlap)(a, b)
