"""Modules that a user adds, and extractors as table functions of SQL.

A module has a name, the version of this interface that it was written for, one of seven kinds, and a function that makes it. A name
is taken once; another major version is refused. What an extractor module makes is a Site, which joins the registry of sites.

`register_functions` gives SQL a polymorphic table function: `SELECT * FROM extract('pypi', TABLE(pages))`. Its columns come from the
site that is named when the query is analysed: those of the table but for the body, a column for each field of the site, and error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..session import ship
from . import sites

#: The interface that modules are written for, and their kinds (fixed values).
VERSION = "1.0.0"
KINDS = ("fetcher", "cleaner", "extractor", "exporter", "notifier", "proxy", "ratelimit")
#: The columns of a table that may hold what is read.
BODIES = ("body", "html")


@dataclass(frozen=True)
class Module:
    name: str
    version: str
    kind: str
    make: Callable[[], Any]


_modules: dict[str, Module] = {}


def _major(version: str) -> int:
    found = re.fullmatch(r"v?(\d+)\.\d+\.\d+(?:[-+].*)?", version)
    if not found:
        raise ValueError(f"{version!r} is no version")
    return int(found[1])


def register_module(module: Module) -> None:
    """Add a module; ValueError without a name, for an unknown kind, another major version, or a name that is taken."""
    if not module.name:
        raise ValueError("a module needs a name")
    if module.kind not in KINDS:
        raise ValueError(f"module {module.name!r} has the unknown kind {module.kind!r}")
    if _major(module.version) != _major(VERSION):
        raise ValueError(f"module {module.name!r} is for version {module.version}, this is {VERSION}")
    if module.name in _modules:
        raise ValueError(f"module {module.name!r} is registered already")
    if module.kind == "extractor":
        sites.register(module.make())
    _modules[module.name] = module


def module(name: str) -> Module:
    if name not in _modules:
        raise KeyError(f"no module {name!r}")
    return _modules[name]


def modules(kind: str | None = None) -> list[str]:
    return sorted(m.name for m in _modules.values() if kind in (None, m.kind))


@dataclass
class Extraction(AnalyzeResult):
    """With what a row is read by: the site, the column of the body, and the columns that stay."""

    site: str = ""
    body: str = ""
    kept: tuple[str, ...] = ()


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)


def _extract(known: dict[str, sites.Site]) -> type:
    class Extract:
        """One row of the site's fields, as texts (what is no text as JSON), for each row of a table with url and body or html."""

        @staticmethod
        def analyze(name: AnalyzeArgument, rows: AnalyzeArgument) -> Extraction:
            if not rows.isTable:
                raise ValueError("extract takes a name and a table")
            if not name.isConstantExpression or name.value not in known:
                raise ValueError(f"no extractor {name.value!r}")
            columns = rows.dataType.fieldNames()
            body = next((b for b in BODIES if b in columns), None)
            if body is None or "url" not in columns:
                raise ValueError("extract needs a table with url and body or html")
            kept = [f for f in rows.dataType.fields if f.name != body]
            taken = {f.name.lower() for f in kept}
            made = [T.StructField(f if f.lower() not in taken else f"{name.value}_{f}", T.StringType()) for f in known[name.value].fields]
            return Extraction(T.StructType([*kept, *made, T.StructField("error", T.StringType())]), site=name.value, body=body, kept=tuple(f.name for f in kept))

        def __init__(self, how: Extraction):
            self.site, self.body, self.kept = known[how.site], how.body, how.kept

        def eval(self, name: str, row: Row) -> Iterator[tuple]:
            record = sites.record_of(self.site, row[self.body], row["url"])
            fields = (_text((record or {}).get(f)) for f in self.site.fields)
            yield *(row[k] for k in self.kept), *fields, None if record else "no data"

    return Extract


def register_functions(spark: SparkSession) -> None:
    """Make `extract` known to a session's SQL, with the sites that are registered now."""
    ship(spark)
    spark.udtf.register("extract", F.udtf(_extract({s.name: s for s in sites.REGISTRY})))
