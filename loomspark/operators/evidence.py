"""Evidence: quotes found in pages, facts settled by corroboration, citations, and what changed between runs."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

LEAST, MOST = 20, 600
# Characters that are swapped when a quote is copied.
FOLDS = {"“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "−": "-", "…": "...", "\u00a0": " ", "`": ""}
_TARGET = re.compile(r"(!?)\[([^\]]*)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)")
_BLOCK = re.compile(r"(?m)^\s*(?:#{1,6}\s+|>\s?)")
_ROW = re.compile(r"(?m)^\s*\|.*\|\s*$")
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_EMPHASIS = re.compile(r"\*+|_+")


def _word(sign: str) -> bool:
    return bool(sign) and (sign.isalpha() or sign.isdigit() or unicodedata.category(sign)[0] in "LN")


def _mark(sign: str) -> bool:
    return bool(sign) and unicodedata.category(sign)[0] in "PS"


def _unlink(text: str) -> str:
    """Links and images become their text, kept apart from words that they touch."""

    def put(m: re.Match) -> str:
        inner, before, after = m[2], text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        left = " " if _word(before) and _word(inner[:1]) else ""
        right = " " if _word(after) and _word(inner[-1:]) else ""
        return left + inner + right

    return _TARGET.sub(put, text)


def _strip_emphasis(text: str) -> str:
    """Runs of * and _ go where they can open or close emphasis; others are text."""

    def put(m: re.Match) -> str:
        before = text[m.start() - 1] if m.start() else " "
        after = text[m.end()] if m.end() < len(text) else " "
        opens = not after.isspace() and (not _mark(after) or before.isspace() or _mark(before))
        closes = not before.isspace() and (not _mark(before) or after.isspace() or _mark(after))
        if m[0][0] == "_":
            strips = opens and (not closes or _mark(before)) or closes and (not opens or _mark(after))
        else:
            strips = opens or closes
        return "" if strips else m[0]

    return _EMPHASIS.sub(put, text)


def normal_text(text: str) -> str:
    """Text folded by what changes in copying: case, spaces, quotes, dashes, markdown's marks."""
    text = _BLOCK.sub("", _unlink(text))
    text = _ROW.sub(lambda m: m[0].replace("|", " "), text)
    text = _strip_emphasis(_ESCAPE.sub(r"\1", text))
    text = "".join(FOLDS.get(c, c) for c in text.lower())
    return " ".join(text.split())


def quote_in(page: str, quote: str) -> bool:
    """page is normal text. The quote must stand at word and number boundaries."""
    q = normal_text(quote).strip(".,;:!?\"' ")
    if not LEAST <= len(q) <= MOST:
        return False
    at = page.find(q)
    while at >= 0:
        end = at + len(q)
        before, after = page[at - 1 : at], page[end : end + 1]
        cut_front = _word(before) and _word(q[0]) or before in (".", ",") and before != "" and q[0].isdigit() and page[at - 2 : at - 1].isdigit()
        cut_back = _word(after) and _word(q[-1]) or after in (".", ",") and after != "" and q[-1].isdigit() and page[end + 1 : end + 2].isdigit()
        if not cut_front and not cut_back:
            return True
        at = page.find(q, at + 1)
    return False


def verify_quotes(facts: DataFrame, pages: DataFrame, key: str = "url") -> DataFrame:
    """Adds found to facts (key, quote) by their page's markdown. A fact without a page is not found.

    The join shuffles by page; a page is normalised once for all its facts in a batch.
    """
    joined = spread(facts.join(pages.select(key, "markdown"), key, "left")).sortWithinPartitions(key)
    schema = T.StructType([*facts.schema.fields, T.StructField("found", T.BooleanType())])

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[str | None, str] = (None, "")
        for pdf in batches:
            found = []
            for page, quote in zip(pdf["markdown"], pdf["quote"], strict=True):
                if page is None or quote is None:
                    found.append(False)
                    continue
                if page is not last[0] and page != last[0]:
                    last = (page, normal_text(page))
                found.append(quote_in(last[1], quote))
            yield pdf.drop(columns="markdown").assign(found=found)

    return joined.select(*facts.columns, "markdown").mapInPandas(check, schema)


def simple_match(page: Column, quote: Column) -> Column:
    """The native part of quote matching: case and white space folded, bounds of length, plain containment."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    q = fold(quote)
    return F.length(q).between(LEAST, MOST) & F.contains(fold(page), q)


def settle(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """status and note of facts (run_id, fact_id, domain, status, note) by evidence (run_id, fact_id, other_id, domain, stance).

    Contradicted facts are contested. A fact that a source of another registrable domain supports is verified, unless it
    was softened; others are softened to what their source says. Evidence without an id does not count.
    """
    known = evidence.where("other_id IS NOT NULL").withColumnRenamed("domain", "other_domain")
    joined = facts.select("run_id", "fact_id", "domain").join(known, ["run_id", "fact_id"], "left")
    supports = (F.col("stance") == "supports") & (F.col("other_domain") != F.col("domain"))
    witness = F.when(supports, F.struct(F.substring("other_id", 2, 18).cast("long").alias("n"), "other_id", "other_domain"))
    found = joined.groupBy("run_id", "fact_id").agg(F.coalesce(F.bool_or(F.col("stance") == "contradicts"), F.lit(False)).alias("contradicted"), F.min(witness).alias("w"))
    out = facts.join(found, ["run_id", "fact_id"], "left")
    by = F.concat(F.lit("corroborated by "), F.col("w.other_id"), F.lit(" ("), F.col("w.other_domain"), F.lit(")"))
    per = F.concat(F.lit("Per "), F.col("domain"), F.lit(": "), F.coalesce("claim", F.lit("")))
    status = F.when(F.coalesce("contradicted", F.lit(False)), "contested").when(F.col("w").isNotNull() & (F.col("status") != "softened"), "verified").otherwise("softened")
    note = F.when(F.coalesce("contradicted", F.lit(False)), F.col("note")).when(F.col("w").isNotNull() & (F.col("status") == "softened"), F.col("note")).when(F.col("w").isNotNull(), by).otherwise(per)
    return out.select("run_id", "fact_id", "domain", status.alias("status"), note.alias("note"))


def writer_order(facts: DataFrame, most: int = 80) -> DataFrame:
    """The facts that a report may use: verified, then softened, then contested, in order of their numbers."""
    rank = F.when(F.col("status") == "verified", 0).when(F.col("status") == "softened", 1).when(F.col("status") == "contested", 2)
    w = Window.partitionBy("run_id").orderBy("rank", F.substring("fact_id", 2, 18).cast("long"))
    return facts.withColumn("rank", rank).where("rank IS NOT NULL").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


@F.pandas_udf(T.StringType())
def folded_quote(quotes: pd.Series) -> pd.Series:
    """Quotes as they are compared."""
    return quotes.map(lambda q: normal_text(q or ""))


def match_facts(before: DataFrame, after: DataFrame, order: str = "fact_id") -> DataFrame:
    """old_id and new_id of the facts (fact_id, url, quote) of two runs that quote the same of the same source.

    Of facts with the same source and quote in one run the first by `order` stands for all; a fact without a counterpart has
    a null on the other side.
    """

    def keyed(facts: DataFrame, name: str) -> DataFrame:
        return facts.withColumn("_quote", folded_quote("quote")).groupBy("url", "_quote").agg(F.min_by("fact_id", order).alias(name))

    return keyed(before, "old_id").join(keyed(after, "new_id"), ["url", "_quote"], "full_outer").select("url", "old_id", "new_id")


def evidence_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """url and change: added, gone or changed, from the newest pin of each source (url, content_hash, checked_at)."""
    newest = lambda df, name: df.groupBy("url").agg(F.max_by("content_hash", "checked_at").alias(name))
    both = newest(before, "old_hash").join(newest(after, "new_hash"), "url", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "gone").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select("url", "change")


_CITE = re.compile(r"\[(f\d+(?:\s*,\s*f\d+)*)\]")


def resolve_citations(report: str, known: dict[str, str]) -> tuple[str, list[str], list[str]]:
    """The report with [f1, f2] as footnotes in order of first use, the sources' lines, and unknown ids."""
    numbers: dict[str, int] = {}
    unknown: list[str] = []

    def put(m: re.Match) -> str:
        out = []
        for fact in re.split(r"\s*,\s*", m[1]):
            if fact not in known:
                unknown.append(fact)
            else:
                out.append(f"[^{numbers.setdefault(fact, len(numbers) + 1)}]")
        return "".join(out)

    text = _CITE.sub(put, report)
    return text, [f"[^{n}]: {known[f]}" for f, n in numbers.items()], unknown


def containing(pages: DataFrame, text: str, quotes: DataFrame, quote: str, anchor: int = 4) -> DataFrame:
    """pages joined with quotes that their text holds, as it stands. Both are to have single spaces between words.

    A quote's inner words stand between spaces wherever it occurs, so `anchor` of them, from its second word on (or all, if it
    has fewer), are among the runs of words of every text that holds it. Hashes of runs meet, without the texts; the
    texts are joined to what has met, by their own hash, and looked up. A quote of one or two words has no inner word: it
    is looked up in every text, as a set that is broadcast.
    """
    words = F.split(F.col(quote), " ")
    length = F.least(F.lit(anchor), F.size(words) - 2)
    asked = quotes.withColumns({"_n": length, "_quote": F.monotonically_increasing_id()})
    long = asked.where("_n > 0").withColumn("_run", F.xxhash64(F.slice(words, F.lit(2), F.col("_n"))))
    short = asked.where("_n <= 0").drop("_n", "_quote")
    sizes = [r._n for r in long.select("_n").distinct().collect()]  # anchor of them at most
    own = F.split(F.col(text), " ")

    def runs_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_words") - n + 1))
        # Distinct as longs: Spark compares the structs of an array with each other, by the square of a text's words.
        runs = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("_words"), i, n))))
        return F.transform(runs, lambda run: F.struct(F.lit(n).alias("_n"), run.alias("_run")))

    runs = [runs_of(n) for n in sizes]
    pages = spread(pages)
    hashed = pages.withColumn("_text", F.xxhash64(text))
    empty = F.array().cast("array<struct<_n:int,_run:bigint>>")
    each = hashed.select("_text", own.alias("_words")).select("_text", F.explode(F.concat(empty, *runs)).alias("r")).select("_text", "r._n", "r._run")
    met = each.join(long, ["_n", "_run"]).select("_text", "_quote", *(F.col(f"`{c}`") for c in quotes.columns)).dropDuplicates(["_text", "_quote"])
    found = hashed.join(met, "_text").where(F.contains(F.col(text), F.col(quote))).drop("_text", "_quote")
    if short.isEmpty():
        return found
    return found.unionByName(pages.join(F.broadcast(short), F.contains(F.col(text), F.col(quote))))
