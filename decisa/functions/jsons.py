"""JSON text as columns: exact canonical form, keys at any depth, and types and members by way of VARIANT."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A whole JSON string, with the colon after it where it is a key. Canonical text has quotes nowhere else.
STRING = r'"(?:[^"\\]++|\\.)*+":?'


#: A token: a string, a mark or a literal.
TOKEN = r'"(?:[^"\\]++|\\.)*+"|[{}\[\],:]|[^\s{}\[\],:"]++'


def parse(text: Column) -> Column:
    """A text as VARIANT; null for what isn't one JSON value: repeated keys, NaN and infinities aren't, nor is a value
    with more behind it, which the parser lets pass: then the text has more tokens than the value."""
    value = F.try_parse_json(text)
    tokens = lambda t: F.regexp_count(t, F.lit(TOKEN))
    return F.when(tokens(text) == tokens(F.to_json(value)), value)


def _once(pairs: list[tuple[str, object]]) -> dict:
    """An object's members, if no key is repeated."""
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("repeated key")
    return dict(pairs)


def _refused(constant: str) -> None:
    raise ValueError(constant)


def canonical_text(text: str | None) -> str | None:
    """canonical() of one text."""
    if text is None:
        return None
    try:
        value = json.loads(text, object_pairs_hook=_once, parse_constant=_refused)
        out = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
        out.encode()
    except (ValueError, RecursionError):
        return None
    return out


def canonical(text: Column) -> Column:
    """Canonical JSON of a text: keys sorted by code point, no spaces, non-ASCII as it is, integers digit for digit and
    other numbers as the shortest text of their double, so that 100, 100.0 and -0.0 differ, and 1E-7 is 1e-07. Null for
    what isn't JSON or can't be kept: repeated keys, NaN, infinities and numbers beyond a double, lone surrogates.

    No built-in function keeps numbers exactly, so this runs in Python on Arrow batches."""

    def of_batch(texts: pd.Series) -> pd.Series:
        return texts.map(canonical_text, na_action="ignore")

    return F.pandas_udf(of_batch, "string")(text)


def identity(text: Column) -> Column:
    """SHA-256 of the canonical form: texts that differ only in spaces or the order of keys have one identity."""
    return F.sha2(canonical(text), 256)


def keys(text: Column) -> Column:
    """All keys of a JSON text at any depth, as often as they are there, in canonical order; null when it isn't JSON."""
    tokens = F.regexp_extract_all(canonical(text), F.lit(STRING), F.lit(0))
    named = F.transform(F.filter(tokens, lambda t: F.endswith(t, F.lit(":"))), lambda t: F.substring(t, F.lit(1), F.length(t) - 1))
    return F.transform(named, lambda t: F.from_json(F.concat(F.lit('{"k":'), t, F.lit("}")), "k string")["k"])


def has_any_key(text: Column, names: Iterable[str]) -> Column:
    """Whether a JSON text has one of the keys at any depth; null when it isn't JSON."""
    return F.arrays_overlap(keys(text), F.array(*[F.lit(n) for n in sorted(names)]))


def kind(value: Column) -> Column:
    """string, number, boolean, array, object or null for a VARIANT, NULL for none."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean").when(schema == "VOID", "null").when(schema.isNotNull(), "number")
    )


def member(value: Column, path: str, type_: str = "variant") -> Column:
    """The member of a VARIANT at a path; NULL where it is missing or no such type."""
    return F.try_variant_get(value, path, type_)


def string_at(value: Column, path: str) -> Column:
    """The member at a path if it is a string."""
    return F.when(kind(member(value, path)) == "string", member(value, path, "string"))


def items_at(value: Column, path: str) -> Column:
    """The member at a path if it is an array, as an array of VARIANT."""
    return F.when(kind(member(value, path)) == "array", member(value, path, "array<variant>"))
