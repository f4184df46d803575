"""Line operators: split, dedupe, runs of short lines, merged number and label lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_short_line


def split(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def dedupe(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first of each repeated line of a text; table, list and quote lines all stay, blank ones go."""
    t = F.trim("line")
    n = F.row_number().over(Window.partitionBy(key, t).orderBy("pos"))
    return lines.withColumn("_n", n).where((t != "") & ((F.col("_n") == 1) | t.rlike(r"^(\||- |>)"))).select(key, "pos", "line")


def mark_short_runs(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """in_run: whether a line belongs to two or more short lines in a row."""
    short = lines.withColumn("short", is_short_line(F.col("line")))
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key, "short").orderBy("pos"))
    sized = short.withColumn("island", island).withColumn("n", F.count("*").over(Window.partitionBy(key, "short", "island")))
    return sized.withColumn("in_run", F.col("short") & (F.col("n") >= 2)).select(key, "pos", "line", "in_run")


def merge_stats(lines: Column) -> Column:
    """An array of lines with each number line and the label line after it as one 'label: number' line.

    No line is a number and a label, so pairs never overlap, and each line's lot is told by its neighbours.
    """
    number, label = r"^\s*[\d.,]+%?\s*$", r"^\s*[A-Za-z][\w\s&/-]{1,40}\s*$"

    def merged(all_lines: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            before, after = F.when(i > 0, F.get(all_lines, i - 1)), F.get(all_lines, i + 1)
            joined = F.concat(F.trim(line), F.lit(": "), F.trim(before))
            taken = line.rlike(number) & F.coalesce(after.rlike(label), F.lit(False))
            return F.when(line.rlike(label) & F.coalesce(before.rlike(number), F.lit(False)), joined).when(~taken, line)

        return F.filter(F.transform(all_lines, one), lambda x: x.isNotNull())

    # The lines are bound once, so that a neighbour is looked up and not computed.
    return F.get(F.transform(F.array(lines), merged), F.lit(0))
