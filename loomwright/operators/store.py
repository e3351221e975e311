"""Tables as a store: numbering, anti-joins, upserts, cascades, neighbours, paging. Tables are immutable files;
each change is a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.session import materialise


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with a global row number in a total order, without gathering rows in one task: rows are sorted by
    range, counted per partition (one small row each), and numbered inside their partition."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order)
    part = materialise(part.withColumn("__part", F.spark_partition_id()), "numbered")
    counts = part.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return part.withColumn("__in", inside).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__in") - 1 + start).cast("long")).drop("__part", "__in", "__before")


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` that ``right`` has no row for."""
    return left.join(right, keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both tables with the latest version of each key; a later table wins ties. By a max over structs, so it is
    gathered per task first."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "__src")).alias("__row"))
    return best.select(*keys, "__row.*").select(*old.columns)


def delete_cascade(parents: DataFrame, children: DataFrame, key: str, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those whose key is in ``doomed``."""
    return parents.join(doomed, key, "left_anti"), children.join(doomed, key, "left_anti")


def merge_collections(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, description, model: new values where they are given, else the old ones."""
    n = new.select("name", F.col("description").alias("d"), F.col("model").alias("m"))
    take = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))
    return old.join(n, "name", "full").select("name", take("d", "description").alias("description"), take("m", "model").alias("model"))


def neighbours(chunks: DataFrame, hits: DataFrame, doc: str, ordinal: str, width: int) -> DataFrame:
    """Each hit (doc, ordinal) with the chunks of its document at most ``width`` places away. A range join turned
    into an equi-join: each hit asks for 2 width + 1 places."""
    asked = hits.select(F.col(doc), F.col(ordinal).alias("hit"), F.explode(F.sequence(F.col(ordinal) - width, F.col(ordinal) + width)).alias(ordinal))
    return asked.join(chunks, [doc, ordinal])


def even_sample(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """``size`` rows at places int(i * total / size) of a total order; all rows if there are no more."""
    rows = numbered(df, order, "__pos")
    total = rows.count()
    if total <= size:
        return rows.drop("__pos")
    # a place p is taken if an i has floor(i * total / size) = p, that is, the two floors around it differ
    i = F.ceil(F.col("__pos") * size / total)
    return rows.where((F.floor(i * total / size) == F.col("__pos")) & (i < size)).drop("__pos")
