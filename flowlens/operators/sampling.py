"""Exact samples, splits and per-class picks without sorting whole tables.

A row's score is a uniform integer in [0, 2^32), normally a hash of its id. The smallest
scores of a group are found from a histogram of their top bits and one of the full scores in the
border bucket, so only rows of one score are ever ranked and the wide rows are filtered where they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.numeric import hash32
from flowlens.operators.joins import join_same, settle
from flowlens.session import checkpointed

SCORE_BITS = 32
BUCKET_BITS = 18


def _border(counts: DataFrame, groups: list[str], cell: str, quota: Column) -> DataFrame:
    """Per group the cell in which the quota ends, and how many of its rows are inside.

    `counts` has the rows `_n` of each cell; `quota` may use `_rows`, the size of the group.
    """
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counts.withColumns({"_upto": F.sum("_n").over(upto), "_rows": F.sum("_n").over(whole)})
    reached = sums.withColumn("_quota", quota.cast("long"))
    inside = (F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota"))
    return reached.filter(inside).select(*groups, cell, (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))


def _cuts(df: DataFrame, groups: list[str], score: Column, tie: str, quota: Column) -> DataFrame:
    """Per group the last (score, tie) inside the quota; groups without a picked row have none.

    Two histograms lead to it: of the top bits over all rows (at most 2^BUCKET_BITS cells a group), and of
    the full scores over the rows of the border buckets, which are written out. Only rows of one
    score are ranked.
    """
    narrow = df.select(*groups, score.cast("long").alias("_score"), F.col(tie).alias("_tie"))
    narrow = narrow.withColumn("_bucket", F.shiftright("_score", SCORE_BITS - BUCKET_BITS).cast("int"))
    counts = narrow.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # One row per group; known beforehand, so that only rows of border buckets move.
    border, small = settle(_border(counts, groups, "_bucket", quota))
    held = checkpointed(join_same(narrow, border, [*groups, "_bucket"], "inner", small=small).drop("_bucket"))
    fine = held.groupBy(*groups, "_score").agg(F.count(F.lit(1)).alias("_n"), F.first("_need").alias("_quota0"))
    last, small = settle(_border(fine, groups, "_score", F.col("_quota0")))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy("_tie"))
    return (
        join_same(held.drop("_need"), last, [*groups, "_score"], "inner", small=small)
        .withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_need"))
        .select(*groups, F.struct("_score", "_tie").alias("_cut"))
    )


def mark_smallest(
    df: DataFrame,
    groups: Sequence[str],
    score: Column,
    tie: str,
    quota: Column,
    name: str = "picked",
) -> DataFrame:
    """Flag the `quota` rows with the smallest (score, tie) of each group.

    `quota` is an expression over `_rows`, the size of the group, and at most that size;
    `tie` is unique. The cuts are computed at once, the flag is a lazy comparison.
    """
    groups = list(groups)
    cuts, small = settle(_cuts(df, groups, score, tie, quota))
    mine = F.struct(score.cast("long").alias("_score"), F.col(tie).alias("_tie"))
    if not groups:
        cut = cuts.select("_cut").scalar()
        return df.withColumn(name, F.coalesce(mine <= cut, F.lit(False)))
    joined = join_same(df, cuts, groups, "left", small=small)
    return joined.withColumn(name, F.coalesce(mine <= F.col("_cut"), F.lit(False))).drop("_cut")


def sample_rows(df: DataFrame, rows: int, id_column: str, seed: int = 42, score: Column | None = None) -> DataFrame:
    """Exactly `rows` uniformly chosen rows, or the whole table if it has no more."""
    score = hash32(F.col(id_column), seed=seed) if score is None else score
    quota = F.least(F.lit(rows), F.col("_rows"))
    return mark_smallest(df, [], score, id_column, quota, "_picked").filter("_picked").drop("_picked")


def sample_fraction(
    df: DataFrame, fraction: float, id_column: str, seed: int = 42, score: Column | None = None
) -> DataFrame:
    """Each row with probability `fraction`; the choice depends only on its id and the seed."""
    score = hash32(F.col(id_column), seed=seed) if score is None else score
    return df.filter(score < F.lit(int(fraction * 2**SCORE_BITS)))


def sample_up_to(df: DataFrame, limit: int, id_column: str, seed: int = 42, score: Column | None = None) -> DataFrame:
    """About `limit` rows of a larger table (fraction limit / total); a smaller one unchanged."""
    total = df.count()
    if total <= limit:
        return df
    return sample_fraction(df, limit / total, id_column, seed, score)


def stratified_split(
    df: DataFrame,
    label: str,
    id_column: str,
    validation_share: float = 0.2,
    seed: int = 42,
    score: Column | None = None,
    name: str = "is_validation",
) -> DataFrame:
    """Flag round(share * rows) rows of every class as validation rows."""
    score = hash32(F.col(id_column), seed=seed) if score is None else score
    quota = F.round(F.lit(validation_share) * F.col("_rows"))
    return mark_smallest(df, [label], score, id_column, quota, name)


def day_roles(
    df: DataFrame,
    day: str,
    validation_share: float = 0.2,
    train_days: Sequence | None = None,
    validation_days: Sequence | None = None,
) -> DataFrame:
    """(day, validates): the role of every day that takes part.

    Days compete by rank: counted from the newest, the first part of the training days validates,
    one day at least. A list of validation days replaces that rule, and `train_days` limits which
    days take part at all; a share of 0 leaves no day for validation.
    """
    days = df.select(F.col(day).alias("_day")).where(F.col(day).isNotNull()).distinct()
    if validation_days:
        validates = F.col("_day").isin(list(validation_days))
        takes_part = validates | F.col("_day").isin(list(train_days)) if train_days else F.lit(True)
        return days.where(takes_part).select("_day", validates.alias("_validates"))
    if train_days:
        days = days.where(F.col("_day").isin(list(train_days)))
    # One row per daily file.
    newest = F.row_number().over(Window.orderBy(F.col("_day").desc()))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    held = F.greatest(F.lit(1), F.floor(total * validation_share)) if validation_share > 0 else F.lit(0)
    return days.select("_day", (newest <= held).alias("_validates"))


def time_split(
    df: DataFrame,
    day: str,
    validation_share: float = 0.2,
    train_days: Sequence | None = None,
    validation_days: Sequence | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train and validation rows by whole days, see `day_roles`; no day is on both sides.

    The roles are small and known at once, so both sides filter on the day column and prune
    partitions.
    """
    roles, _ = settle(day_roles(df, day, validation_share, train_days, validation_days))
    sides = {role: [r["_day"] for r in roles.where(F.col("_validates") == role).collect()] for role in (False, True)}
    if not sides[False]:
        raise ValueError("no day is left for training")
    return tuple(df.filter(F.col(day).isin(sides[role])) for role in (False, True))


def epoch_order(df: DataFrame, id_column: str, epoch: int, seed: int = 42, score: Column | None = None) -> DataFrame:
    """Rows in a pseudo-random order that differs per epoch and repeats for equal seeds."""
    score = hash32(F.col(id_column), seed=seed + epoch) if score is None else score
    return df.withColumn("_score", score).orderBy("_score", id_column).drop("_score")


def first_per_class(
    df: DataFrame, label: str, targets: Sequence[str], rows: int, order: Sequence[str]
) -> DataFrame:
    """First `rows` rows of every target class, listed in the order of the targets."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    place = F.array_position(F.lit(list(targets)), F.col(label))
    return (
        df.filter(F.col(label).isin(list(targets)))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= rows)
        .orderBy(place, "rank")
    )


#: How many rows of a class a demonstration trace may have.
TRACE_ROWS = range(10, 21)


def trace_shortages(picked: DataFrame, label: str, targets: Sequence[str], rows: int) -> DataFrame:
    """(label, rows) of the target classes with fewer than `rows` picked rows, those without any included."""
    wanted = picked.sparkSession.createDataFrame([(t,) for t in targets], f"`{label}` string").distinct()
    counts = picked.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    return wanted.join(counts, label, "left").na.fill(0, ["rows"]).where(F.col("rows") < rows)


def pick_traces(
    df: DataFrame, label: str, targets: Sequence[str], rows: int, order: Sequence[str]
) -> DataFrame:
    """`first_per_class` for demonstration traces; an error names the classes that are short.

    The picks, a few rows per class, are computed once.
    """
    if rows not in TRACE_ROWS:
        raise ValueError(f"a trace has {TRACE_ROWS[0]} to {TRACE_ROWS[-1]} rows per class, not {rows}")
    picked, _ = settle(first_per_class(df, label, targets, rows, order))
    missing = trace_shortages(picked, label, targets, rows).orderBy(label).collect()
    if missing:
        raise ValueError(f"classes below {rows} rows: {[tuple(row) for row in missing]}")
    return picked


def last_rows(df: DataFrame, rows: int, order: Sequence[str]) -> DataFrame:
    """The newest `rows` rows."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(rows)


def concat_days(*days: DataFrame) -> DataFrame:
    """All rows of several day tables; columns absent from one are NULL there."""
    result = days[0]
    for day in days[1:]:
        result = result.unionByName(day, allowMissingColumns=True)
    return result
