"""Registrable domains by public-suffix rules from a file: wildcards, exceptions, names outside ASCII.

A rule is a suffix of labels; `*.x` takes any one label before x, `!a.x` takes a.x out of that again. Of the rules that a host
ends with, an exception wins, else the one with most labels; where none does, the last label is the suffix. Every host is exploded into its
suffixes in each of the three writings, so one equi-join on the rule's text finds all that match; the rules are as many
as the file has, and Spark broadcasts them while they are small.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship


@F.pandas_udf(T.StringType())
def ascii_name(names: pd.Series) -> pd.Series:
    """Names as they stand in the DNS (xn--...); what cannot be written so stays."""

    def write(name: str | None) -> str | None:
        if name is None or name.isascii():
            return name
        try:
            return ".".join(label.encode("idna").decode() for label in name.split("."))
        except UnicodeError:
            return name

    return names.map(write)


def suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """rule: the rules of a file of public suffixes, one a line; comments (//) and what follows a space are left out."""
    lines = ship(spark).read.text(path).select(F.lower(F.regexp_extract("value", r"^\s*(\S*)", 1)).alias("rule"))
    return rules_of(lines.where("rule <> '' AND NOT startswith(rule, '//')"))


def rules_of(rules: DataFrame) -> DataFrame:
    """rule, as rules are compared: without dots at the ends, in the writing of the DNS, each once."""
    sign = F.regexp_extract("rule", r"^(!|\*\.)?", 1)
    name = F.regexp_replace(F.regexp_replace("rule", r"^(?:!|\*\.)?\.*", ""), r"\.+$", "")
    return rules.where("rule <> '*'").select(F.concat(sign, ascii_name(name)).alias("rule")).where("rule <> ''").distinct()


def _last(labels: Column, n: Column) -> Column:
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def registrable(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """host, suffix and domain of every different host: the public suffix and one label more.

    Case and a last dot do not count. Addresses, hosts of one label, hosts with empty labels and public suffixes themselves are
    their own domain, the first three without a suffix. Null hosts are left out.
    """
    names = hosts.select(F.col(host).alias("host")).where("host IS NOT NULL").distinct()
    plain = ascii_name(F.regexp_replace(F.lower("host"), r"\.$", ""))
    labels = F.split(plain, r"\.")
    given = names.select("host", plain.alias("name"), labels.alias("labels"))
    address = F.col("name").rlike(r"^\d+(?:\.\d+){3}$") | F.contains(F.col("name"), F.lit(":"))
    usable = ~address & (F.size("labels") > 1) & ~F.array_contains("labels", "")

    n = F.col("n")
    tail = F.when(n > 1, F.concat(F.lit("*."), _last(F.col("labels"), n - 1)))
    own = _last(F.col("labels"), n)
    writings = F.array(F.struct(own.alias("rule"), n.alias("size"), F.lit(False).alias("but")), F.struct(tail.alias("rule"), n.alias("size"), F.lit(False).alias("but")), F.struct(F.concat(F.lit("!"), own).alias("rule"), (n - 1).alias("size"), F.lit(True).alias("but")))
    keys = given.where(usable).select("host", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n")).select("host", F.inline(writings))
    met = keys.where("rule IS NOT NULL").join(rules, "rule").groupBy("host").agg(F.max(F.struct("but", "size")).alias("best"))
    found = given.withColumn("usable", usable).join(met, "host", "left").withColumn("size", F.coalesce("best.size", F.lit(1)))
    suffix = F.when(F.col("usable"), _last(F.col("labels"), F.col("size")))
    domain = F.when(F.col("usable") & (F.col("size") < F.size("labels")), _last(F.col("labels"), F.col("size") + 1)).otherwise(F.col("name"))
    return found.select("host", suffix.alias("suffix"), domain.alias("domain"))
