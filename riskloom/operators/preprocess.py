"""Governance preprocessor (G1–G7, P4, P26, A36) as an estimator/model pair.

``fit`` runs a fixed number of distributed passes regardless of the column
count (one chunked numeric profile, one categorical profile, one long-form
mode/separator pass) and keeps only small fitted state on the driver: column
lists and one fill value per column.  ``transform`` is a single projection.

Order of the checks: missingness → leakage (name, correlation, separator)
→ variance → imputation values.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..sources.tables import split_columns
from .profiling import categorical_profile, name_leaks, numeric_profile, q, separator_test


@dataclass
class PreprocessorModel:
    input_columns: list[str]
    output_columns: list[str]
    numeric_features: list[str]
    categorical_features: list[str]
    dropped_missing: list[str]
    dropped_leakage: list[str]
    dropped_low_variance: list[str]
    impute_values: dict = field(default_factory=dict)
    leakage_rules: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Exactly the fitted columns, missing ones filled, NaN/'nan'/'None' imputed."""
        present = set(df.columns)
        cols = []
        for c in self.output_columns:
            fill = self.impute_values.get(c, 0.0 if c in self.numeric_features else "UNKNOWN")
            if c in self.categorical_features:
                src = q(c).cast("string") if c in present else F.lit(None).cast("string")
                src = F.when(src.isin("nan", "None"), F.lit(None).cast("string")).otherwise(src)
                cols.append(F.coalesce(src, F.lit(str(fill))).alias(c))
            else:
                src = q(c).try_cast("double") if c in present else F.lit(None).cast("double")
                src = F.when(F.isnan(src), F.lit(None).cast("double")).otherwise(src)
                cols.append(F.coalesce(src, F.lit(float(fill))).alias(c))
        keep = [q(c) for c in df.columns if c not in self.output_columns and c not in self.input_columns]
        return df.select(*keep, *cols)

    def save(self, spark: SparkSession, path: str) -> None:
        """The fitted state as one JSON record."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "state string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "PreprocessorModel":
        return cls(**json.loads(spark.read.text(path).first()[0]))

    def report(self, spark: SparkSession) -> DataFrame:
        """One row per input column with the decision and its reason."""
        rows = []
        for pos, c in enumerate(self.input_columns):
            if c in self.dropped_missing:
                d, r = "dropped", "missing_threshold"
            elif c in self.dropped_leakage:
                d, r = "dropped", "target_leakage:" + ",".join(self.leakage_rules.get(c, []))
            elif c in self.dropped_low_variance:
                d, r = "dropped", "low_variance"
            else:
                d, r = "kept", "numeric" if c in self.numeric_features else "categorical"
            v = self.impute_values.get(c)
            rows.append((c, pos, d, r, None if v is None else str(v)))
        return spark.createDataFrame(rows, "feature string, position int, decision string, reason string, impute_value string")


    def audit(self, spark: SparkSession) -> DataFrame:
        """What was dropped for which reason and what is left, as counts and lists."""
        lists = {"missing_threshold": self.dropped_missing, "target_leakage": self.dropped_leakage, "low_variance": self.dropped_low_variance,
                 "numeric": self.numeric_features, "categorical": self.categorical_features, "input": self.input_columns, "output": self.output_columns}
        return spark.createDataFrame([(k, len(v), list(v)) for k, v in lists.items()], "section string, n long, features array<string>")


@dataclass
class GovernancePreprocessor:
    missing_threshold: float = K.MISSING_THRESHOLD
    variance_threshold: float = K.VARIANCE_THRESHOLD
    max_leakage_correlation: float = K.LEAKAGE_CORRELATION
    numeric_strategy: str = "median"          # or "mean"
    categorical_strategy: str = "most_frequent"  # or "constant_missing"

    def fit(self, df: DataFrame, target: str | None = K.TARGET_COLUMN, exclude: list[str] | None = None) -> PreprocessorModel:
        exclude = set(exclude or [])
        cols = [c for c in df.columns if c != target and c not in exclude]
        numeric, categorical = split_columns(df.select(*[q(c) for c in cols]))
        n_rows = df.count()
        y_numeric = target is not None and isinstance(df.schema[target].dataType, (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.ByteType))
        nprof = {r["feature"]: r for r in numeric_profile(df, numeric, target if y_numeric else None).collect()} if numeric else {}
        cprof = {r["feature"]: r for r in categorical_profile(df, categorical).collect()} if categorical else {}

        def missing_frac(c):
            r = nprof.get(c) or cprof.get(c)
            return (n_rows - r["n"]) / n_rows if n_rows else 0.0

        dropped_missing = [c for c in cols if missing_frac(c) > self.missing_threshold]
        active = [c for c in cols if c not in dropped_missing]

        rules: dict[str, list[str]] = {}
        if target is not None:
            for c in name_leaks(active, target):
                rules.setdefault(c, []).append("name_overlap")
            if y_numeric:
                for c in active:
                    r = nprof.get(c)
                    if r is not None and r["corr_target"] is not None and abs(r["corr_target"]) >= self.max_leakage_correlation:
                        rules.setdefault(c, []).append("high_correlation")
            act_cat = [c for c in active if c in cprof]
            if act_cat:
                for r in separator_test(df, act_cat, target).filter("is_separator").collect():
                    rules.setdefault(r["feature"], []).append("deterministic_separator")
        dropped_leakage = [c for c in active if c in rules]
        active = [c for c in active if c not in rules]

        low_var = []
        for c in active:
            if c in nprof:
                v = nprof[c]["var_pop"]
                if v is None or v != v or v <= self.variance_threshold:
                    low_var.append(c)
            elif cprof[c]["n_distinct_le1"]:
                low_var.append(c)
        out = [c for c in active if c not in low_var]
        num_out = [c for c in out if c in nprof]
        cat_out = [c for c in out if c in cprof]
        impute = {}
        for c in num_out:
            v = nprof[c]["median"] if self.numeric_strategy == "median" else nprof[c]["mean"]
            impute[c] = 0.0 if v is None else float(v)
        for c in cat_out:
            m = cprof[c]["mode"] if self.categorical_strategy == "most_frequent" else None
            impute[c] = m if m is not None else "UNKNOWN"
        return PreprocessorModel(cols, out, num_out, cat_out, dropped_missing, dropped_leakage, low_var, impute, rules)
