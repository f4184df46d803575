"""Differences between two keyed record sets, field by field, as joins on the long form.

A record is a row of side-specific JSON or of columns; its long form has a row for each leaf: key, path, kind and
text. Kinds keep "19.99" apart from 19.99; strings are compared with their white space collapsed, numbers in
canonical form, long texts by their hash. The sides meet in one full outer join on the key, with their leaves in arrays
by path, so each side is shuffled once and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse

LONG_TEXT, SHOWN = 1024, 256


def leaf(value: Column, kind: T.DataType) -> Column:
    """struct(kind, text, is_long) of a typed column."""
    if isinstance(kind, T.StringType):
        name, text = "s", collapse(value)
    elif isinstance(kind, T.BooleanType):
        name, text = "t", value.cast("string")
    elif isinstance(kind, T.NumericType):
        name = "n"
        whole = value.cast("double") == F.floor(value.cast("double"))
        text = value.cast("string") if isinstance(kind, T.IntegralType) else F.when(whole & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(value.cast("string"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        name, text = "a", F.to_json(value)
    else:
        name, text = "s", value.cast("string")
    kind_name = F.when(value.isNull(), F.lit("z")).otherwise(F.lit(name))
    is_long = F.octet_length(text) > LONG_TEXT
    kept = F.when(value.isNull(), F.lit("null")).when(is_long, F.sha2(text, 256)).otherwise(text)
    return F.struct(kind_name.alias("kind"), kept.alias("text"), F.coalesce(is_long, F.lit(False)).alias("is_long"))


def _walk(prefix: str, column: Column, kind: T.DataType, key: str, ignore: tuple[str, ...]):
    if prefix == key or any(prefix == i or prefix.startswith(i + ".") for i in ignore):
        return
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _walk(f"{prefix}.{f.name}", column.getField(f.name), f.dataType, key, ignore)
    else:
        yield prefix, leaf(column, kind)


def leaves(records: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> dict[str, Column]:
    """Dotted path -> leaf; nested structs are walked, arrays are one leaf."""
    return dict(x for f in records.schema.fields for x in _walk(f.name, F.col(f"`{f.name}`"), f.dataType, key, ignore))


def long_form(records: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """key, path, kind, text, is_long: a row for each leaf."""
    each = [F.struct(F.lit(p).alias("path"), x.alias("leaf")) for p, x in leaves(records, key, ignore).items()]
    rows = records.select(F.col(key).cast("string").alias("key"), F.explode(F.array(*each)).alias("x"))
    return rows.select("key", "x.path", "x.leaf.kind", "x.leaf.text", "x.leaf.is_long")


#: Tasks of the join for each split of the input that the records come from.
TASKS_A_SPLIT = 8


def tasks_for(source: DataFrame) -> int:
    """Tasks that a table's records are compared in: by its splits, so that a task's records do not grow with the table."""
    return max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), TASKS_A_SPLIT * source.rdd.getNumPartitions())


def matched(prev: DataFrame, cur: DataFrame, key: str, ignore: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """key, in_prev, in_cur and changes, an array of (path, old, new): one full outer join on the key.

    tasks: that many, which Spark does not put together by their packed bytes; otherwise as many as Spark finds fit.

    A path that only one side has is a change of every record there. Null keys match nothing and go.
    """
    sides = [leaves(df, key, ignore) for df in (prev, cur)]
    paths = sorted({*sides[0], *sides[1]})
    missing = F.lit(None).cast("struct<kind:string,text:string,is_long:boolean>")

    def wide(df: DataFrame, own: dict[str, Column], name: str) -> DataFrame:
        row = F.array(*(own.get(p, missing) for p in paths)) if paths else F.array()
        rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), row.alias(name))
        return rows.repartition(tasks, "key") if tasks else rows

    both = wide(prev, sides[0], "old").join(wide(cur, sides[1], "new"), "key", "full_outer")
    each = F.transform(F.array(*map(F.lit, paths)), lambda p, i: F.struct(p.alias("path"), F.get("old", i).alias("old"), F.get("new", i).alias("new")))
    differ = F.filter(each, lambda x: ~x["old"].eqNullSafe(x["new"]))
    changes = F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), differ)
    return both.select("key", F.col("old").isNotNull().alias("in_prev"), F.col("new").isNotNull().alias("in_cur"), changes.alias("changes"))


def last_by_key(records: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key; adds repeats, how many came before it. Null keys go."""
    w = Window.partitionBy(key)
    ranked = records.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w.orderBy(F.desc(order))))
    return ranked.withColumn("repeats", F.count("*").over(w) - 1).where("_n = 1").drop("_n")


def field_changes(prev: DataFrame, cur: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """key, path, old, new, long of every leaf that differs in records of both sides; a missing leaf is null."""
    rows = matched(prev, cur, key, ignore).select("key", F.explode("changes").alias("c"))
    is_long = F.coalesce("c.old.is_long", F.lit(False)) | F.coalesce("c.new.is_long", F.lit(False))
    return rows.select("key", "c.path", F.col("c.old.text").alias("old"), F.col("c.new.text").alias("new"), is_long.alias("long"))


def row_kinds(prev: DataFrame, cur: DataFrame, key: str, ignore: tuple[str, ...] = (), unseen: DataFrame | None = None, no_gone: bool = False, tasks: int | None = None) -> DataFrame:
    """key and kind (added, changed or gone). unseen: keys that were not looked at; a partial run has no_gone."""
    kind = F.when(~F.col("in_prev"), "added").when(~F.col("in_cur"), "gone").when(F.size("changes") > 0, "changed")
    rows = matched(prev, cur, key, ignore, tasks).select("key", kind.alias("kind")).where("kind IS NOT NULL")
    if no_gone:
        rows = rows.where("kind <> 'gone'")
    if unseen is not None:
        names = unseen.select(F.col(unseen.columns[0]).cast("string").alias("key")).distinct().withColumn("_unseen", F.lit(True))
        rows = rows.join(names, "key", "left").where("NOT (kind = 'gone' AND _unseen IS NOT NULL)").drop("_unseen")
    return rows


def ordered_rows(kinds: DataFrame, most: int = 200) -> DataFrame:
    """The first `most` rows: added, changed, gone, each by key. A report's cap; counts are exact elsewhere."""
    rank = F.when(F.col("kind") == "added", 0).when(F.col("kind") == "changed", 1).otherwise(2)
    return kinds.withColumn("kind_rank", rank).orderBy("kind_rank", "key").limit(most)


def counts(kinds: DataFrame) -> DataFrame:
    return kinds.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("added", "changed", "gone")))


def report_lines(kinds: DataFrame, changes: DataFrame) -> DataFrame:
    """One line of text for each change: + key, - key, ~ key path: old -> new."""
    shown = lambda c: F.left(F.coalesce(F.col(c), F.lit("(absent)")), F.lit(SHOWN))
    text = F.when(F.col("long"), F.concat(F.lit("~ "), F.col("key"), F.lit(" "), F.col("path"), F.lit(" (long field, hash differs)")))
    text = text.otherwise(F.concat(F.lit("~ "), F.col("key"), F.lit(" "), F.col("path"), F.lit(": "), shown("old"), F.lit(" -> "), shown("new")))
    simple = kinds.where("kind <> 'changed'").select("key", F.concat(F.when(F.col("kind") == "added", "+ ").otherwise("- "), F.col("key")).alias("line"))
    return simple.unionByName(changes.select("key", text.alias("line")))
