"""Audits of a labelled corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_accounting(df: DataFrame, split: str, a: str, b: str) -> DataFrame:
    """(level, split, a, b, n): row counts by split, each label, both labels, and in all, in one pass."""
    g = df.groupingSets([[F.col(split)], [F.col(a)], [F.col(b)], [F.col(a), F.col(b)], []], F.col(split), F.col(a), F.col(b))
    out = g.agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))
    level = F.element_at(F.create_map(*[F.lit(x) for x in (3, "split", 5, "label_a", 6, "label_b", 4, "label_pair", 7, "all")]), F.col("gid").cast("int"))
    return out.select(level.alias("level"), F.col(split).cast("string").alias("split"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), "n")


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) of every column, in one pass."""
    names = df.columns
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names])
    return wide.unpivot([], names, "column", "nulls")


def cross_table(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``row`` against each of ``values``, zero where there are none, and their total."""
    names = [F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values]
    return df.groupBy(row).agg(*names, F.count(F.lit(1)).alias("total"))


def first_per_group(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("n") <= n)


def systematic_sample(df: DataFrame, index: str, total: int, wanted: int) -> DataFrame:
    """Every k-th row with k = ceil(total / wanted)."""
    return df.where(F.col(index) % max(1, -(-total // wanted)) == 0)


def duplicate_groups(df: DataFrame, digest: Column, split: Column, label: Column, generator: Column) -> DataFrame:
    """(digest, n, n_splits, n_labels, n_generators, in_...) for each digest of more than one row; counts and masks are
    partial aggregates, so a digest that many rows share is not gathered."""
    bit = lambda k: F.max(F.when(split == k, 1).otherwise(0)) == 1
    return (
        df.groupBy(digest.alias("digest"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[bit(k).alias(f"in_{k}") for k in (0, 1, 2)],
            (F.min(label) != F.max(label)).alias("cross_label"),
            (F.min(generator) != F.max(generator)).alias("cross_generator"),
        )
        .where("n > 1")
    )


def duplicate_summary(groups: DataFrame) -> DataFrame:
    c = lambda x, n: F.count_if(F.expr(x)).alias(n)
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_groups"),
        c("in_0 AND in_1", "cross_01"),
        c("in_0 AND in_2", "cross_02"),
        c("in_1 AND in_2", "cross_12"),
        c("cross_label", "cross_label"),
        c("cross_generator", "cross_generator"),
    )


def aspect_category(width: Column, height: Column) -> Column:
    r = width / height
    return F.when(F.abs(r - 1) < 0.001, "square").when(r > 1.001, "landscape").otherwise("portrait")


def crop_box(width: Column, height: Column) -> list[Column]:
    """side, left and top of the centred square."""
    side = F.least(width, height)
    return [side.alias("side"), F.floor((width - side) / 2).cast("int").alias("left"), F.floor((height - side) / 2).cast("int").alias("top")]


def caption_groups(df: DataFrame, caption: Column, label: Column, generator: Column) -> DataFrame:
    """(caption, n, cross_label, cross_generator) of captions with more than one row."""
    g = df.groupBy(caption.alias("caption")).agg(F.count(F.lit(1)).alias("n"), (F.min(label) != F.max(label)).alias("cross_label"), (F.min(generator) != F.max(generator)).alias("cross_generator"))
    return g.where("n > 1")


def set_overlap(df: DataFrame, key: Column, split: Column, splits: int = 3) -> DataFrame:
    """(mask, n): how many different keys occur in exactly the splits whose bits are set in ``mask``."""
    masks = df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.bit_or(F.pow(F.lit(2), split).cast("int")).alias("mask"))
    return masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule, in one pass; null counts as broken."""
    wide = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
    return wide.unpivot([], list(rules), "rule", "n")


def signature(tables: Column, ids: Column | None = None) -> Column:
    """`T{id}:{first 8 of MD5}` of each quantisation table (arrays of integers as image_headers() gives them, hashed as
    `(16, 11, ...)`), sorted and joined by `;`, or NO_Q_TABLE without any. Without ``ids`` a table's place is its id."""

    def part(t: Column, i: Column) -> Column:
        text = F.concat(F.lit("("), F.array_join(t.cast("array<string>"), ", "), F.lit(")"))
        return F.concat(F.lit("T"), (i if ids is None else F.get(ids, i)).cast("string"), F.lit(":"), F.substring(F.md5(text.cast("binary")), 1, 8))

    return F.when(F.size(tables) > 0, F.array_join(F.array_sort(F.transform(tables, part)), ";")).otherwise("NO_Q_TABLE")
