"""JSON columns as VARIANT: path walks, flattening to dotted leaves, leaf kinds and canonical text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapse

LONG_TEXT = 1024


def path(json: Column, walk: str, kind: str = "string") -> Column:
    """$.a.0.b: numbers index arrays; null if the path leads nowhere. An array of blocks is tried block by block by blocks()."""
    if not walk.startswith("$."):
        raise ValueError("a path begins with $.")
    steps = "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in walk[2:].split("."))
    return F.try_variant_get(F.try_parse_json(json), "$" + steps, kind)


def blocks(json: Column, walk: str, kind: str = "string", most: int = 8) -> Column:
    """The first block of an array of blocks in which the path leads somewhere; also takes a single block."""
    rest = walk[2:]
    return F.coalesce(path(json, walk, kind), *(path(json, f"$.{i}.{rest}", kind) for i in range(most)))


def leaf(value: Column) -> Column:
    """struct(kind, text, is_long) of a VARIANT: s, n, t, z or a; long texts as their hash."""
    kind = F.schema_of_variant(value)
    code = F.when(value.isNull() | (kind == "VOID"), "z").when(kind == "STRING", "s").when(kind == "BOOLEAN", "t").when(kind.rlike("^(ARRAY|OBJECT)"), "a").otherwise("n")
    raw = F.try_variant_get(value, "$", "string")
    text = F.when(code == "z", F.lit("null")).when(code == "s", collapse(raw)).when(code == "a", F.to_json(value)).otherwise(raw)
    is_long = F.octet_length(text) > LONG_TEXT
    return F.struct(code.alias("kind"), F.when(is_long, F.sha2(text, 256)).otherwise(text).alias("text"), is_long.alias("is_long"))


def flatten(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, path, kind, text, is_long for each leaf of a JSON object, paths dotted, arrays whole.

    The depth is not known beforehand, so the walk is an Arrow-batched Python function; numbers keep their digits.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, *leaf) for k, text in zip(pdf[key], pdf[json], strict=True) if text is not None for leaf in leaves(text)]
            yield pd.DataFrame(out, columns=[key, "path", "kind", "text", "is_long"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, json).mapInPandas(walk, f"{key} {kind}, path string, kind string, text string, is_long boolean")


class Number(str):
    """A JSON number with its digits as written."""


def load(text: str):
    import json as parser

    return parser.loads(text, parse_int=Number, parse_float=Number)


def number_text(n: str) -> str:
    """Whole numbers as written, others as the shortest form of the double."""
    return repr(float(n)) if any(c in n for c in ".eE") else str(n)


def canonical(value) -> str:
    """Canonical JSON text: sorted keys, collapsed strings, canonical numbers."""
    import json as parser

    if isinstance(value, Number):
        return number_text(value)
    if isinstance(value, str):
        return parser.dumps(" ".join(value.split()), ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{parser.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    return {None: "null", True: "true", False: "false"}[value]


def leaves(text: str) -> list[tuple[str, str, str, bool]]:
    """(path, kind, text, is_long) of a JSON object's leaves, in order of paths; nothing for other values."""
    import hashlib

    try:
        top = load(text)
    except ValueError:
        return []
    out = []

    def visit(prefix: str, value) -> None:
        if isinstance(value, dict) and (value or not prefix):
            for k in sorted(value):
                visit(f"{prefix}.{k}" if prefix else k, value[k])
            return
        if isinstance(value, Number):
            kind, shown = "n", number_text(value)
        elif isinstance(value, str):
            kind, shown = "s", " ".join(value.split())
        elif isinstance(value, bool):
            kind, shown = "t", canonical(value)
        elif value is None:
            kind, shown = "z", "null"
        else:
            kind, shown = "a", canonical(value)
        is_long = len(shown.encode()) > LONG_TEXT
        out.append((prefix, kind, hashlib.sha256(shown.encode()).hexdigest() if is_long else shown, is_long))

    if isinstance(top, dict):
        visit("", top)
    return out
