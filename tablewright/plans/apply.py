"""Plans as bits, and their application to a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.analysis.summary import column_variances
from tablewright.plans.transforms import LOG_VARIANCE, TRANSFORMS, Setting, transform_names, type_default

Plan = tuple[int, ...]


def chosen_columns(plan: Sequence[int], columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns each transform applies to: one bit per transform and column."""
    names = transform_names()
    if len(plan) != len(names) * len(columns):
        raise ValueError(f"a plan for {len(columns)} columns has {len(names) * len(columns)} bits")
    width = len(columns)
    return {
        name: [c for c, bit in zip(columns, plan[i * width : (i + 1) * width]) if bit]
        for i, name in enumerate(names)
    }


def plan_bits(chosen: Mapping[str, Sequence[str]], columns: Sequence[str]) -> Plan:
    """The plan that chooses the given columns per transform."""
    return tuple(int(c in chosen.get(name, ())) for name in transform_names() for c in columns)


def effective_plan(plan: Plan, df: DataFrame, setting: Setting) -> Plan:
    """The plan without bits that change no row of the table.

    Plans with the same effect then share one fitness: null rows and defaults
    matter where there are nulls, the log applies to double columns of large
    variance, the constant to one column, and sorting leaves a model's input
    as it is.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    chosen = chosen_columns(plan, df.columns)
    kept = dict(chosen)
    kept["trans1"] = [c for c in chosen["trans1"] if c in setting.nullable]
    kept["trans2"] = chosen["trans2"][:1]
    kept["trans3"] = [
        c
        for c in chosen["trans3"]
        if isinstance(types[c], T.DoubleType)
        and setting.variances.get(c, 0.0) > LOG_VARIANCE
        and c not in kept["trans2"]
    ]
    nulls_left = set(setting.nullable) - set(kept["trans1"]) - set(kept["trans2"])
    nulls_left |= set(kept["trans3"])  # the log of a number that is not positive
    kept["trans4"] = [
        c for c in chosen["trans4"] if c in nulls_left and type_default(types[c]) is not None
    ]
    kept["trans5"] = []
    return plan_bits(kept, df.columns)


def make_setting(df: DataFrame, constant: int = 0, sort: bool = True) -> Setting:
    """Variances of the base table and which of its columns hold nulls."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    nullable = frozenset(c for c in df.columns if nulls[c])
    return Setting(column_variances(df), nullable, constant, sort)


def apply_plan(df: DataFrame, plan: Sequence[int], setting: Setting) -> DataFrame:
    """Apply all transforms of a plan in name order."""
    for name, columns in chosen_columns(plan, df.columns).items():
        df = TRANSFORMS[name](df, columns, setting)
    return df
