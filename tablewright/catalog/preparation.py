"""Queries of group Q: data-preparation plans and their search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalog.registry import Tables, query
from tablewright.catalog.selections import CUSTOMER_WITH_NULLS, customer_with_nulls
from tablewright.functions.features import label_features
from tablewright.plans import fitness as fit
from tablewright.plans.actions import Actions, load_actions, parse_actions
from tablewright.plans.apply import apply_plan, make_setting, plan_bits
from tablewright.plans.search import plan_search
from tablewright.plans.transforms import TRANSFORMS, transform_names


@query(
    "q01_parse_actions",
    """SELECT p_partkey, CASE WHEN first THEN 1 ELSE 3 END AS level,
         CASE WHEN NOT first AND contains(target, 'all') THEN '' ELSE replace(target, ' ', '|') END AS targets,
         replace(action, ' ', '|') AS actions,
         CASE WHEN NOT first AND contains(object, 'any') THEN '' ELSE replace(object, ' ', '|') END AS objects
       FROM (SELECT *, target <> 'all' AND action <> 'related_to' AND object <> 'any' AS first FROM (
         SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'all' ELSE p_name END AS target,
           CASE WHEN p_size % 2 = 0 THEN 'filter' ELSE 'related_to' END AS action,
           CASE WHEN p_size % 3 = 0 THEN 'any' ELSE lower(p_type) || ' ' || p_brand END AS object FROM part))""",
)
def parsed_actions(t: Tables):
    size = F.col("p_size")
    actions = t.part.select(
        F.when(size % 5 == 0, "all").otherwise(F.col("p_name")).alias("target"),
        F.when(size % 2 == 0, "filter").otherwise("related_to").alias("action"),
        F.when(size % 3 == 0, "any")
        .otherwise(F.concat_ws(" ", F.lower("p_type"), "p_brand"))
        .alias("object"),
        "p_partkey",
    )
    parsed = parse_actions(actions, keep=["p_partkey"])
    joined = {c: F.array_join(c, "|") for c in ["targets", "actions", "objects"]}
    return parsed.withColumns(joined)


@query(
    "q02_apply_plan",
    f"""SELECT c_custkey, coalesce(c_name, '') AS c_name, c_nationkey,
          round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS c_acctbal, 7 AS c_mktsegment
        FROM ({CUSTOMER_WITH_NULLS}) WHERE c_nationkey IS NOT NULL""",
)
def applied_plan(t: Tables):
    base = customer_with_nulls(t)
    plan = plan_bits(
        {
            "trans1": ["c_nationkey"],
            "trans2": ["c_mktsegment"],
            "trans3": ["c_acctbal", "c_custkey"],
            "trans4": ["c_name"],
            "trans5": ["c_custkey"],
        },
        base.columns,
    )
    made = apply_plan(base, plan, make_setting(base, constant=7))
    return made.withColumn("c_acctbal", F.round("c_acctbal", 6))


@query(
    "g11_transform_registry",
    f"""SELECT c_custkey, c_name, coalesce(c_nationkey, 0) AS c_nationkey,
          round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS c_acctbal, 5 AS c_mktsegment
        FROM ({CUSTOMER_WITH_NULLS}) WHERE c_name IS NOT NULL""",
)
def registry(t: Tables):
    """Every registered transform by name, one column choice each."""
    df = customer_with_nulls(t)
    setting = make_setting(df, constant=5)
    choices = [["c_name"], ["c_mktsegment"], ["c_acctbal"], ["c_nationkey"], []]
    for name, chosen in zip(transform_names(), choices):
        df = TRANSFORMS[name](df, chosen, setting)
    return df.withColumn("c_acctbal", F.round("c_acctbal", 6))


ACTION_ROWS = [
    ("c_acctbal", "filter", "null"),
    ("n_regionkey n_name", "related_to", "c_nationkey c_mktsegment"),
    ("n_regionkey", "related_to", "any"),
    ("all", "related_to", "meaningful"),
]


def base_table(t: Tables):
    """Customers with their nation: the table to prepare."""
    nations = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    joined = customer_with_nulls(t).join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("n_regionkey", "n_name", "c_nationkey", "c_mktsegment", "c_acctbal")


def actions(t: Tables) -> Actions:
    return load_actions(t.spark.createDataFrame(ACTION_ROWS, "target string, action string, object string"))


def labelled(t: Tables):
    """Region from nation and segment."""
    return label_features(
        base_table(t).na.drop(subset=["n_regionkey"]), ["n_regionkey"], ["c_nationkey", "c_mktsegment"]
    )


def _one_error(t: Tables, name: str):
    data = labelled(t).persist()
    try:
        error = fit.FITNESS[name](data, 1234)
    finally:
        data.unpersist()
    return t.spark.createDataFrame([(name, error)], "model string, error double")


@query("q03_fitness_tree")
def fitness_tree(t: Tables):
    return _one_error(t, "tree")


@query("q04_fitness_text_lr")
def fitness_text(t: Tables):
    return _one_error(t, "text")


@query("q05_fitness_mlp")
def fitness_perceptron(t: Tables):
    return _one_error(t, "perceptron")


@query("q06_fitness_forest")
def fitness_forest(t: Tables):
    return _one_error(t, "forest")


@query("q07_fitness_gbt")
def fitness_boosted(t: Tables):
    return _one_error(t, "boosted")


@query("q08_plan_fitness")
def plan_fitness(t: Tables):
    base = base_table(t)
    wanted = actions(t)
    plan = plan_bits({"trans1": ["c_nationkey"], "trans4": ["c_acctbal"]}, base.columns)
    table = apply_plan(base, plan, make_setting(base, sort=False))
    levels = fit.column_levels(base.columns, wanted.targets, wanted.objects)
    results = fit.plan_fitness(table, levels)
    rows = [
        (r.weight, model, error, r.best, fit.score(results))
        for r in results
        for model, error in r.errors.items()
    ]
    return t.spark.createDataFrame(
        rows, "weight int, model string, error double, best double, score double"
    )


@query("q09_plan_search_table")
def searched_table(t: Tables):
    """The table that the best plan found makes."""
    return plan_search(base_table(t), actions(t), seed=9).table


@query("q09_plan_search")
def searched(t: Tables):
    return plan_search(base_table(t), actions(t), seed=9).history
