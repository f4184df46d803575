"""Decisions of a host program as plain functions and columns: providers, exit codes, retries, proxies, arguments."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Providers by name: whether they need a key, and whether they are paid at a flat rate (fixed values).
KEYED, FLAT, LOCAL = ("openai", "anthropic", "openrouter", "gemini"), ("codex",), ("ollama",)
#: Exit codes by what failed (fixed values).
EXIT_CODES = {"options": 2, "scope": 2, "private_address": 2, "proxy": 2, "url_mismatch": 2, "no_pages": 3, "robots": 5, "cost_ceiling": 6, "missing_key": 7, "quality": 8, "challenge": 8}
#: Answers that no retry mends, and answers and errors that one may mend (fixed values).
FINAL = (400, 401, 403, 404, 410)
TRIES, FIRST_WAIT, MOST_WAIT, MOST_TOTAL = 4, 0.5, 30.0, 120.0
ERROR_LENGTH = 1000


def is_free_model(model: Column) -> Column:
    """Models that cost nothing by their name."""
    m = F.lower(model)
    return m.startswith("ollama/") | m.startswith("llama") | m.endswith(":free")


def is_flat_rate(provider: Column) -> Column:
    return F.lower(provider).isin(*FLAT)


def needs_key(provider: Column) -> Column:
    """Unknown providers count as keyed, so that a misspelt one never spends; no provider needs none."""
    return F.when(F.coalesce(provider, F.lit("")) == "", F.lit(False)).otherwise(~F.lower(provider).isin(*FLAT, *LOCAL))


def exit_code(failure: Column) -> Column:
    """0 for none, 1 for a failure without a code of its own."""
    out = F.when(F.coalesce(failure, F.lit("")) == "", 0)
    for name, code in EXIT_CODES.items():
        out = out.when(failure == name, code)
    return out.otherwise(1)


def error_message(message: Column) -> Column:
    """The first ERROR_LENGTH characters."""
    return F.left(message, F.lit(ERROR_LENGTH))


def run_id() -> str:
    return uuid.uuid4().hex


def retry_wait(attempt: Column, status: Column, retry_after: Column, seed: Column) -> Column:
    """Seconds to wait before the next try after `attempt` (from 1), or null if there is to be none.

    Waits double from FIRST_WAIT to MOST_WAIT, each between a half and one and a half times that, by a hash of the seed, so
    that a replay waits alike; 429 and 503 wait what they ask for. A null status is a failed connection.
    """
    base = F.least(F.lit(MOST_WAIT), F.lit(FIRST_WAIT) * F.pow(F.lit(2.0), attempt - 1))
    jitter = F.lit(0.5) + F.pmod(F.xxhash64(seed, attempt), F.lit(1 << 20)) / F.lit(float(1 << 20))
    asked = F.when(status.isin(429, 503) & retry_after.isNotNull(), retry_after.cast("double"))
    over = (attempt >= TRIES) | F.coalesce(status.isin(*FINAL) | status.between(200, 299), F.lit(False))
    return F.when(~over, F.coalesce(asked, base * jitter))


def retries_in_time(waits: Column) -> Column:
    """Of an array of waits, the first ones that end within MOST_TOTAL seconds."""
    total = lambda i: F.aggregate(F.slice(waits, 1, i + 1), F.lit(0.0), lambda a, x: a + x)
    return F.filter(F.transform(waits, lambda x, i: F.when(total(i) <= MOST_TOTAL, x)), lambda x: x.isNotNull())


def session_token(host: Column, secret: str = "") -> Column:
    """A host's stable token of eight hexadecimal digits."""
    return F.left(F.sha2(F.concat(F.lit(secret), F.lower(host)), 256), F.lit(8))


def choose_proxy(proxies: list[str], dead_until: list[float], now: float, host: str, turn: int, sticky: bool) -> int:
    """The number of a proxy that is not in cooldown: by turn, or always the same for a host; ValueError if all are."""
    alive = [i for i, until in enumerate(dead_until) if until <= now]
    if not alive:
        raise ValueError(f"all {len(proxies)} proxies are in cooldown")
    return alive[(sum(ord(c) * 31**i for i, c in enumerate(host.lower())) if sticky else turn) % len(alive)]


def flexible(value, kind: str):
    """A tool's argument as int, bool, list or map, from itself or from text; null stays null, and no number is cut."""
    if value is None or kind not in ("int", "bool", "list", "map"):
        return value
    read = value
    if isinstance(value, str):
        try:
            read = json.loads(value.strip().lower() if kind == "bool" else value)
        except ValueError:
            read = [v.strip() for v in value.split(",") if v.strip()] if kind == "list" else value
    if kind == "list" and not isinstance(read, (list, dict)):
        read = [value if isinstance(value, str) else read]
    if kind == "int" and isinstance(read, float) and read.is_integer():
        read = int(read)
    fits = {"int": isinstance(read, int) and not isinstance(read, bool), "bool": isinstance(read, bool), "list": isinstance(read, list), "map": isinstance(read, dict)}
    if not fits[kind]:
        raise ValueError(f"{value!r} is no {kind}")
    return read
