"""JSON texts of any depth without the members that are named like secrets."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SECRET_KEY, secret_key


def names_in(json: Column) -> Column:
    """Member names of a JSON text at every depth; an escape inside a name becomes U+0001."""
    plain = F.regexp_replace(json, r"(?s)\\.", "\u0001")
    strings = F.regexp_extract_all(plain, F.lit(r'"[^"]*"(?:\s*:)?'), F.lit(0))
    return F.transform(F.filter(strings, lambda s: F.endswith(s, F.lit(":"))), lambda s: F.regexp_extract(s, r'^"([^"]*)"', 1))


def holds_secrets(json: Column) -> Column:
    """Whether a name of a secret stands in a JSON text at any depth, or one that can't be told without reading it."""
    return F.exists(names_in(json), lambda n: secret_key(n) | F.contains(n, F.lit("\u0001")))


#: Strings and signs of a compact JSON text; what is between them are numbers, true, false and null.
_PARTS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],]', re.S)
_SECRET = re.compile(SECRET_KEY, re.A)


def _is_secret(name: str) -> bool:
    """The rule of :func:`functions.text.secret_key`."""
    return _SECRET.search(name) is not None and not name.lower().endswith("_env")


def _cut(text: str) -> str:
    """A compact JSON text without its secret members, in one pass; what stays keeps its spelling."""
    out: list[str] = []
    # depth; depth of the object whose member is being left out; place up to which the text is written or left out
    depth, skip, at = 0, -1, 0
    for m in _PARTS.finditer(text):
        sign, end = m[0], m.end()
        if sign[0] == '"':
            # a string before a colon is a member's name
            if skip < 0 and text[end : end + 1] == ":" and _is_secret(json.loads(sign)):
                out.append(text[at : m.start()])
                skip = depth
        elif sign in "{[":
            depth += 1
        elif sign == ",":
            if skip == depth:
                # the comma goes with the member
                skip, at = -1, end
        else:
            if skip == depth:
                # of the last member the comma before it goes, if one was written
                skip, at = -1, m.start()
                _drop_comma(out)
            depth -= 1
    out.append(text[at:])
    return "".join(out)


def _drop_comma(out: list[str]) -> None:
    while out and not out[-1]:
        out.pop()
    if out and out[-1].endswith(","):
        out[-1] = out[-1][:-1]


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held, texts = b.column(2).to_pylist(), b.column(1).to_pylist()
        clean = [_cut(t) if h else t for t, h in zip(texts, held, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clean, pa.string())], names=b.schema.names[:2])


def without_secrets(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key`` and ``column`` of ``df``: JSON texts without the members that are named like secrets, in objects and lists of any depth.

    Texts come back compact, with the keys of objects sorted; a null or malformed text gives null. Nothing is shuffled: Spark's parser makes the text compact, and one pass over
    it cuts the members out, whatever its depth; texts that hold no such name are left as they are.
    """
    kind = df.schema[key].dataType.simpleString()
    base = df.select(key, F.to_json(F.try_parse_json(F.col(column))).alias(column))
    # the text or an escape may spell such a name; the pass over it tells
    base = base.withColumn("_held", F.coalesce(F.col(column).rlike(SECRET_KEY + r"|\\"), F.lit(False)))
    return base.mapInArrow(_cut_batches, f"`{key}` {kind}, `{column}` string")
