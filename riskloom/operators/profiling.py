"""Column profiling and leakage audit.

Every profile is one pass over the long form ``(feature, position, value)``: each row is
unpivoted once, whatever the number of columns, and every statistic is a mergeable
aggregate by feature (partial aggregation map-side).  Medians, modes and separator tests go
through ``groupBy(feature, value)``, so no column's values are ever collected into one
task, and are exact at any size.  NaN and the texts 'nan' and 'None' count as missing (S6).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..sources.tables import missing_to_null, split_columns
from .ranking import prefix_sum


def q(c: str) -> Column:
    return F.col(f"`{c}`")


def clean(df: DataFrame, c: str) -> Column:
    """Column ``c`` with what counts as missing turned to NULL."""
    return missing_to_null(q(c), df.schema[c].dataType)


def _unpivot(df: DataFrame, cols: list[str], kind: str, extra: list[Column] | None = None) -> DataFrame:
    """Rows ``(*extra, feature, position, value)``, missing values as NULL."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), clean(df, c).cast(kind).alias("value"))
                     for i, c in enumerate(cols)])
    return df.select(*(extra or []), F.inline_outer(rows))


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column missing count, fraction, dtype and rank, most-missing first (ties: column order)."""
    cols = columns or df.columns
    dtypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    n = F.count(F.lit(1))
    prof = _unpivot(df, cols, "string").groupBy("feature", "position").agg(
        (n - F.count("value")).alias("missing_count"), ((n - F.count("value")) / n).alias("missing_percentage"))
    dt = df.sparkSession.createDataFrame([(c, dtypes[c]) for c in cols], "feature string, dtype string")
    # one row per column is left here
    rank = F.row_number().over(Window.orderBy(F.desc("missing_count"), "position"))
    return prof.join(F.broadcast(dt), "feature").withColumn("missing_rank", rank).orderBy("missing_rank")


def medians(values: DataFrame) -> DataFrame:
    """Exact median of ``value`` by ``feature``: rows (feature, median).

    Equal values are counted first; a distributed prefix sum over the distinct values
    finds those that hold the middle ranks, so neither a feature nor a hot value is one
    task's work.
    """
    counts = values.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("c"))
    ranked = prefix_sum(counts, [F.col("feature"), F.col("value")], ["c"])
    # ranks run on through all features: each starts at the least count before its values
    span = ranked.groupBy("feature").agg(F.min("c_before").alias("start"), F.sum("c").alias("n"))
    lower, upper = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    at = F.col("c_before") - F.col("start")

    def holds(rank: Column) -> Column:
        return (at <= rank) & (rank < at + F.col("c"))

    middle = ranked.join(span, "feature").where(holds(lower) | holds(upper)).groupBy("feature").agg(
        F.max(F.when(holds(lower), F.col("value"))).alias("lo"), F.max(F.when(holds(upper), F.col("value"))).alias("hi"))
    return middle.select("feature", ((F.col("lo") + F.col("hi")) / 2).alias("median"))


def numeric_profile(df: DataFrame, numeric: list[str], target: str | None = None) -> DataFrame:
    """N, var_pop, mean, min, max, median and target correlation by column.

    ``corr_target`` is the pairwise-complete Pearson correlation, NULL when a
    side is constant (ANSI-safe ``try_divide``; ``corr`` would throw).
    """
    extra = [clean(df, target).cast("double").alias("y")] if target is not None else []
    values = _unpivot(df, numeric, "double", extra)
    x = F.col("value")
    out = [F.count(x).alias("n"), F.var_pop(x).alias("var_pop"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max")]
    if target is not None:
        xp, yp = F.when(F.col("y").isNotNull(), x), F.when(x.isNotNull(), F.col("y"))
        out.append(F.try_divide(F.covar_pop(xp, yp), F.stddev_pop(xp) * F.stddev_pop(yp)).alias("corr_target"))
    stats = values.groupBy("feature", "position").agg(*out)
    return stats.join(medians(values), "feature", "left")


def categorical_profile(df: DataFrame, categorical: list[str]) -> DataFrame:
    """Distinct-≤1 test (min = max) and deterministic mode per column.

    The mode goes through ``groupBy(column, value).count()``, reduced map-side;
    the most frequent value per column (ties → the smallest) is a ``min_by``.
    """
    if not categorical:
        schema = "feature string, position int, n long, n_distinct_le1 boolean, mode string"
        return df.sparkSession.createDataFrame([], schema)
    values = _unpivot(df, categorical, "string")
    base = values.groupBy("feature", "position").agg(
        F.count("value").alias("n"), F.coalesce(F.min("value") == F.max("value"), F.lit(True)).alias("n_distinct_le1"))
    counts = values.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    modes = counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode"))
    return base.join(modes, "feature", "left")


def long_form(df: DataFrame, columns: list[str], extra: list[str] | None = None) -> DataFrame:
    """Unpivot ``columns`` to ``(column, value)`` strings (plus ``extra`` columns kept)."""
    return _unpivot(df, columns, "string", [q(e) for e in extra or []]).drop("position")


def separator_test(df: DataFrame, categorical: list[str], target: str) -> DataFrame:
    """A categorical column separates the target when every category
    (NULLs dropped) holds at most one target class and there is more than one
    category."""
    if not categorical:
        return df.sparkSession.createDataFrame([], "feature string, n_categories long, is_separator boolean")
    lf = long_form(df, categorical, [target]).filter(F.col("value").isNotNull() & q(target).isNotNull())
    per_cat = lf.groupBy("feature", "value").agg((F.min(q(target)) == F.max(q(target))).alias("pure"))
    return per_cat.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_categories"),
        (F.bool_and("pure") & (F.count(F.lit(1)) > 1)).alias("is_separator"),
    )


def name_leaks(columns: list[str], target: str) -> list[str]:
    """Lower-cased name contains the target name and a leak marker (driver-side, names only)."""
    t = target.lower().strip()
    return [c for c in columns if c != target and t in c.lower().strip()
            and any(m in c.lower().strip() for m in K.LEAK_NAME_MARKERS)]


def leakage_audit(df: DataFrame, target: str, threshold: float = K.LEAKAGE_CORRELATION,
                  numeric_prof: DataFrame | None = None) -> DataFrame:
    """Long report ``(column, rule, value, reason)`` of the three checks."""
    spark = df.sparkSession
    feats = [c for c in df.columns if c != target]
    numeric, categorical = split_columns(df.select(*[q(c) for c in feats]))
    names = name_leaks(feats, target)
    name_rows = spark.createDataFrame(
        [(c, "name_overlap", None, f"Name similarity indicating target derivation: '{c}' contains '{target}'")
         for c in names], "feature string, rule string, value double, reason string")
    target_numeric = target in split_columns(df.select(q(target)))[0]
    parts = [name_rows]
    if target_numeric and numeric:
        prof = numeric_prof if numeric_prof is not None else numeric_profile(df, numeric, target)
        hc = prof.select("feature", F.abs("corr_target").alias("v")).filter(F.col("v") >= F.lit(threshold))
        parts.append(hc.select(
            "feature", F.lit("high_correlation").alias("rule"), F.col("v").alias("value"),
            F.concat(F.lit("Absolute correlation score of "), F.format_string("%.5f", "v"),
                     F.lit(f" is >= threshold {threshold}")).alias("reason")))
    if categorical:
        sep = separator_test(df, categorical, target).filter("is_separator")
        parts.append(sep.select(
            "feature", F.lit("deterministic_separator").alias("rule"), F.lit(None).cast("double").alias("value"),
            F.lit("Perfect partition. Category values perfectly separate target state (post-facto metadata leak risk).")
            .alias("reason")))
    return reduce(lambda a, b: a.unionByName(b), parts)
