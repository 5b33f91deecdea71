"""Genetic search for the plan whose table is easiest to model.

Only plans (short bit strings) live on the driver; every fitness is computed
by Spark on one cached base table.  A generation is scored at once: the column
levels that its plans need and that no plan has needed before are collected,
those that hold the same data are one, and all of them are fitted side by side.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.features import string_columns
from tablewright.operators.columns import model_columns
from tablewright.plans.actions import Actions, apply_filters
from tablewright.plans.apply import (
    Plan,
    apply_plan,
    chosen_columns,
    effective_plan,
    make_setting,
)
from tablewright.plans.fitness import (
    FITNESS,
    Level,
    LevelResult,
    column_levels,
    plan_fitness,
    score,
)
from tablewright.plans.transforms import transform_names


def random_plan(length: int, rng: random.Random) -> Plan:
    return tuple(rng.randint(0, 1) for _ in range(length))


def cross(a: Plan, b: Plan, rng: random.Random) -> tuple[Plan, Plan]:
    """Swap the tails of two plans behind a random point."""
    point = rng.randrange(1, len(a))
    return a[:point] + b[point:], b[:point] + a[point:]


def flip_one(plan: Plan, rng: random.Random) -> Plan:
    place = rng.randrange(len(plan))
    return plan[:place] + (1 - plan[place],) + plan[place + 1 :]


@dataclass
class Generation:
    number: int
    best: float | None
    plans: int
    evaluated: int


@dataclass
class Search:
    """A seeded search; `evaluate` maps a list of plans to their fitnesses, smaller is better."""

    evaluate: Callable[[list[Plan]], list[float | None]]
    length: int
    population: int = 100
    generations: int = 100
    mutation_rate: float = 0.1
    seed: int = 0
    memo: dict[Plan, float | None] = field(default_factory=dict)
    history: list[Generation] = field(default_factory=list)
    best_plan: Plan | None = None
    best_fitness: float | None = None

    def learn(self, plans: Iterable[Plan]) -> None:
        """Evaluate at once the plans not seen before."""
        new = [p for p in dict.fromkeys(plans) if p not in self.memo]
        if new:
            self.memo.update(zip(new, self.evaluate(new)))

    def fitness(self, plan: Plan) -> float:
        """Fitness of a plan, computed once; no valid model counts as worst."""
        self.learn([plan])
        value = self.memo[plan]
        return math.inf if value is None else value

    def _remember(self, number: int, plans: Iterable[Plan]) -> None:
        plans = list(plans)
        leader = min(plans, key=lambda p: (self.fitness(p), p))
        if self.best_plan is None or self.fitness(leader) < self.fitness(self.best_plan):
            self.best_plan, self.best_fitness = leader, self.memo[leader]
        self.history.append(Generation(number, self.best_fitness, len(plans), len(self.memo)))

    def _mutated(self, plan: Plan, rng: random.Random) -> Plan:
        """The plan, now and then with one bit flipped."""
        return flip_one(plan, rng) if rng.random() < self.mutation_rate else plan

    def run(self) -> Plan:
        rng = random.Random(self.seed)
        plans = [random_plan(self.length, rng) for _ in range(self.population)]
        self.learn(plans)
        self._remember(0, plans)
        for number in range(1, self.generations + 1):
            half = sorted(plans, key=lambda p: (self.fitness(p), p))[: max(2, self.population // 2)]
            children = []
            for i, plan in enumerate(half):
                spouse = rng.choice([p for j, p in enumerate(half) if j != i])
                children += cross(plan, spouse, rng)
            children = children[: self.population]
            changed = [self._mutated(p, rng) for p in children]
            self.learn([*children, *changed])
            # A flip stays unless it is worse.
            plans = [c if self.fitness(c) <= self.fitness(p) else p for p, c in zip(children, changed)]
            self._remember(number, plans)
        assert self.best_plan is not None
        return self.best_plan


#: Sets of columns that are null together, with the rows that have them.
NullPatterns = Mapping[frozenset[str], int]


def null_patterns(df: DataFrame, nullable: Iterable[str]) -> NullPatterns:
    """One aggregate: which columns are null together in how many rows.

    As many entries as patterns occur, whatever the number of rows.
    """
    names = sorted(nullable)
    if not names:
        return {frozenset(): 1}
    marks = [F.col(f"`{n}`").isNull().alias(f"n{i}") for i, n in enumerate(names)]
    found = df.groupBy(*marks).count().collect()
    return {frozenset(n for i, n in enumerate(names) if r[f"n{i}"]): r["count"] for r in found}


def level_input(plan: Plan, columns: Sequence[str], level: Level, patterns: NullPatterns | None = None, texts: Iterable[str] | None = None) -> tuple:
    """What a plan changes for one level: the rows it keeps and how it
    transforms the level's own columns.

    With the table's null patterns, plans that drop the same rows for nulls in
    different columns agree.  With its text columns, so do plans that fill
    numbers: null counts as 0 in a model, and a text is filled only where a
    kept row is without it.
    """
    usable = model_columns(columns, level.targets, level.features)
    used = [*usable["targets"][:1], *usable["features"]]
    chosen = chosen_columns(plan, columns)
    dropped: tuple | frozenset = tuple(chosen["trans1"])
    changes = {t: tuple(c for c in chosen[t] if c in used) for t in ("trans2", "trans3", "trans4")}
    if patterns is not None:
        dropped = frozenset(p for p in patterns if p & set(chosen["trans1"]))
        left = frozenset().union(*[p for p in patterns if p not in dropped])
        if texts is not None:
            changes["trans4"] = tuple(c for c in changes["trans4"] if c in left and c in set(texts) and c not in changes["trans2"])
    return (level, dropped, *changes.values())


@dataclass
class SearchResult:
    plan: Plan
    fitness: float | None
    table: DataFrame
    history: DataFrame


def plan_search(
    df: DataFrame,
    actions: Actions,
    population: int = 100,
    generations: int = 100,
    mutation_rate: float = 0.1,
    seed: int = 0,
    constant: int = 0,
    models: Sequence[str] = tuple(FITNESS),
    at_once: int = 4,
) -> SearchResult:
    """Search plans for a table and return the best one's table.

    The table is filtered by the actions and cached once.  A level is fitted
    once for all plans that give it the same rows and columns; the levels a
    generation needs are fitted side by side, `at_once` plans at a time.
    """
    base = apply_filters(df, actions.filters).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        setting = make_setting(base, constant, sort=False)
        levels = column_levels(base.columns, actions.targets, actions.objects)
        patterns, texts = null_patterns(base, setting.nullable), string_columns(base)
        known: dict[tuple, LevelResult] = {}

        def fit_levels(job: tuple[Plan, list[tuple]]) -> list[LevelResult]:
            effect, missing = job
            return plan_fitness(apply_plan(base, effect, setting), [key[0] for key in missing], models=models)

        def evaluate(plans: list[Plan]) -> list[float | None]:
            effects = [effective_plan(p, base, setting) for p in plans]
            keys = [[level_input(e, base.columns, level, patterns, texts) for level in levels] for e in effects]
            asked: set[tuple] = set()
            jobs = []
            for effect, own in zip(effects, keys):
                missing = [k for k in own if k not in known and k not in asked]
                if missing:
                    asked.update(missing)
                    jobs.append((effect, missing))
            with ThreadPoolExecutor(max_workers=at_once) as pool:
                for (_, missing), results in zip(jobs, pool.map(fit_levels, jobs)):
                    known.update(zip(missing, results))
            return [score([known[k] for k in own]) for own in keys]

        search = Search(
            evaluate,
            len(transform_names()) * len(base.columns),
            population,
            generations,
            mutation_rate,
            seed,
        )
        plan = search.run()
    finally:
        base.unpersist()
    history = df.sparkSession.createDataFrame(
        [(g.number, g.best, g.plans, g.evaluated) for g in search.history],
        "generation int, best double, plans int, evaluated int",
    )
    final = apply_plan(apply_filters(df, actions.filters), plan, replace(setting, sort=True))
    return SearchResult(plan, search.best_fitness, final, history)
