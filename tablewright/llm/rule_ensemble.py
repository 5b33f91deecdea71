"""Text quality by a sparse rule ensemble.

Boosted shallow trees over statistics of a text give rules: every path from
the root to a node is a conjunction of thresholds.  A lasso logistic
regression over the rules, as 0/1 columns, keeps few of them.  The rules that
stay are compiled into one Spark column, so that scoring is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.texts import fold_of

#: Bound of the labelled sample that is fitted on the driver, which holds one row of statistics for each.
MAX_ROWS = 8192
#: Trees, their depth, the share of rows each sees, the step of boosting, thresholds tried a statistic, rows a node needs.
TREES, DEPTH, ROW_SHARE, RATE, CUTS, LEAST_ROWS = 60, 3, 0.5, 0.1, 32, 10
#: Lasso weights tried, as shares of the least one that keeps no rule; the share of rows that chooses among them.
PENALTIES, CHOOSING = (0.3, 0.1, 0.03, 0.01, 0.003, 0.001), 0.2
STEPS, SEED = 400, 13

SPACE = r"[\x20\x09-\x0D]+"
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and a to in is that it was for on are as with by "
    "der die das und den von zu mit ist im für ein eine nicht "
    "le la les de des du un une et en est que dans pour qui sur "
    "el los las una y del por con se su al es no"
).split()


STATISTICS = (
    "log_words", "letters_per_word", "upper_share", "digit_share", "symbol_share", "sentence_ends_per_word", "exclamations_per_word", "mark_runs_per_word",
    "function_word_share", "distinct_word_share", "distinct_line_share", "words_per_line", "word_again_share", "longest_word", "links_per_word",
)


def statistics(texts: DataFrame) -> DataFrame:
    """`text` replaced by STATISTICS, numbers of the whole text, never null; an empty text gives 0 throughout.

    The words and lines are columns of a step before, so that they are cut once.
    """
    t = F.coalesce("text", F.lit(""))
    others = [c for c in texts.columns if c != "text"]
    cut = texts.select(
        *others, t.alias("text"), F.split(F.lower(t), SPACE).alias("words"), F.split(t, r"\s*\n\s*").alias("lines"), F.regexp_replace(t, r"[\p{L}\p{M}]+", "").alias("bare"),
    )
    cut = cut.select(
        *others, "text", F.array_remove("words", "").alias("words"), F.array_remove("lines", "").alias("lines"), "bare", F.regexp_replace("bare", r"[\s.,;:'\"()-]+", " ").alias("marks")
    )

    def share(part: Column, whole: Column) -> Column:
        return part.cast("double") / F.greatest(whole.cast("double"), F.lit(1.0))

    def count(pattern: str, column: str = "text") -> Column:
        return F.regexp_count(column, F.lit(pattern))

    n_words, n_lines, letters = F.size("words"), F.size("lines"), F.length("text") - F.length("bare")
    again = F.aggregate("words", F.struct(F.lit("").alias("last"), F.lit(0).alias("n")), lambda a, w: F.struct(w.alias("last"), (a["n"] + (a["last"] == w).cast("int")).alias("n")))
    return cut.select(
        *others,
        F.log1p(n_words.cast("double")).alias("log_words"),
        share(letters, n_words).alias("letters_per_word"),
        share(count(r"\p{Lu}"), letters).alias("upper_share"),
        share(count(r"\d", "marks"), F.length("text")).alias("digit_share"),
        share(count(r"[^\s\d.!?]", "marks"), F.length("text")).alias("symbol_share"),
        share(count(r"[.?]", "bare"), n_words).alias("sentence_ends_per_word"),
        share(count("!", "marks"), n_words).alias("exclamations_per_word"),
        share(count(r"[^\s\d]{2,}", "marks"), n_words).alias("mark_runs_per_word"),
        share(F.size(F.filter("words", lambda w: w.isin(FUNCTION_WORDS))), n_words).alias("function_word_share"),
        share(F.size(F.array_distinct("words")), n_words).alias("distinct_word_share"),
        share(F.size(F.array_distinct("lines")), n_lines).alias("distinct_line_share"),
        share(n_words, n_lines).alias("words_per_line"),
        share(again["n"], n_words).alias("word_again_share"),
        F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)).cast("double").alias("longest_word"),
        share(count(r"https?://|www\.|</?[A-Za-z]"), n_words).alias("links_per_word"),
    )


@dataclass(frozen=True, order=True)
class Condition:
    """A statistic above a threshold, or not above it."""

    statistic: str
    threshold: float
    above: bool

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        over = table[self.statistic] > self.threshold
        return over if self.above else ~over

    def column(self) -> Column:
        over = F.col(self.statistic) > F.lit(self.threshold)
        return over if self.above else ~over


Rule = tuple[Condition, ...]


def fires(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(np.logical_and, [c.holds(table) for c in rule])


def grow(table: dict[str, np.ndarray], cuts: dict[str, np.ndarray], rows: np.ndarray, pull: np.ndarray, weight: np.ndarray, path: Rule = ()):
    """(path, rows, value) of every node below the root of one tree, depth first.

    A split takes the largest gain of a Newton step; `pull` and `weight` are
    the loss's negative gradient and curvature of each row.
    """

    def worth(g, w):
        return g * g / (w + 1.0)

    if len(path) == DEPTH:
        return
    best = (1e-6, None, 0.0)
    g_all, w_all = pull[rows].sum(), weight[rows].sum()
    for name, points in cuts.items():
        if not len(points):
            continue
        # A value falls into the bin of the number of cuts below it.
        at = np.searchsorted(points, table[name][rows], side="left")
        n = np.cumsum(np.bincount(at, minlength=len(points) + 1))[:-1]
        g = np.cumsum(np.bincount(at, pull[rows], len(points) + 1))[:-1]
        w = np.cumsum(np.bincount(at, weight[rows], len(points) + 1))[:-1]
        gain = worth(g, w) + worth(g_all - g, w_all - w) - worth(g_all, w_all)
        gain[(n < LEAST_ROWS) | (len(rows) - n < LEAST_ROWS)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), name, float(points[k]))
    if best[1] is None:
        return
    for above in (False, True):
        condition = Condition(best[1], best[2], above)
        inside = rows[condition.holds({best[1]: table[best[1]][rows]})]
        own = tidy((*path, condition))
        yield own, inside, pull[inside].sum() / (weight[inside].sum() + 1.0)
        yield from grow(table, cuts, inside, pull, weight, own)


def tidy(path: Rule) -> Rule:
    """Conditions in order, of those on one side of one statistic only the tightest."""
    tight: dict[tuple[str, bool], float] = {}
    for c in path:
        key = (c.statistic, c.above)
        tight[key] = c.threshold if key not in tight else (max if c.above else min)(tight[key], c.threshold)
    return tuple(sorted(Condition(name, at, above) for (name, above), at in tight.items()))


def tree_rules(table: dict[str, np.ndarray], y: np.ndarray) -> list[Rule]:
    """The distinct paths of boosted trees, each grown on a random share of the rows."""
    rng = np.random.default_rng(SEED)
    # Half way between two values, so that rounding never moves a row across a threshold.
    cuts = {}
    for name, values in table.items():
        seen = np.unique(values)
        chosen = np.unique(np.quantile(seen, np.linspace(0, 1, CUTS + 2)[1:-1], method="lower")) if len(seen) > CUTS else seen[:-1]
        by_rows = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 2)[1:-1], method="lower"))
        low = np.union1d(chosen, by_rows)
        low = low[low < seen[-1]]
        cuts[name] = (low + seen[np.searchsorted(seen, low, side="right")]) / 2
    prior = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    logit = np.full(len(y), np.log(prior / (1 - prior)))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        pull, weight = y - p, p * (1 - p)
        rows = np.flatnonzero(rng.random(len(y)) < ROW_SHARE)
        nodes = list(grow(table, cuts, rows, pull, weight))
        for path, _, value in nodes:
            rules[path] = None
            inner = any(set(path) < set(other) for other, _, _ in nodes)
            if not inner:
                logit[fires(path, table)] += RATE * np.clip(value, -4, 4)
    return list(rules)


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray) -> np.ndarray:
    """Weights (the last one the free intercept) of least mean log loss + penalty * sum |w|, by accelerated proximal steps."""
    lipschitz = np.linalg.norm(x, 2) ** 2 / 4 / len(y) + 1e-12
    w, ahead, t = start.copy(), start.copy(), 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        moved = ahead - x.T @ (p - y) / len(y) / lipschitz
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - penalty / lipschitz, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = moved + (t - 1) / t_next * (moved - w)
        if np.abs(moved - w).max() < 1e-7:
            return moved
        w, t = moved, t_next
    return w


def log_loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = x @ w
    return float(np.mean(np.logaddexp(0, z) - y * z))


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1, of a row that has the statistics as columns."""
        terms = [F.when(reduce(lambda a, b: a & b, [c.column() for c in rule]), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in zip(self.rules, self.weights)]
        logit = reduce(lambda a, b: a + b, terms, F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def fit(table: dict[str, np.ndarray], y: np.ndarray) -> Ensemble:
    """Rules from trees, lasso weights, the penalty that does best on rows left out of the lasso.

    Rows of one label only, or none: the smoothed share of label 1 alone.
    """
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Ensemble([], [], float(np.log(share / (1 - share))))
    found = tree_rules(table, y)
    # Rules that hold for the same rows are one; those that hold for all or none say nothing.
    first: dict[bytes, tuple[Rule, np.ndarray]] = {}
    for rule in sorted(found, key=lambda r: (len(r), r)):
        on = fires(rule, table)
        if 0 < on.sum() < len(y):
            first.setdefault(min(on.tobytes(), (~on).tobytes()), (rule, on))
    rules = [r for r, _ in first.values()]
    x = np.column_stack([on for _, on in first.values()] + [np.ones(len(y))]).astype(np.float64)
    left_out = np.random.default_rng(SEED + 1).random(len(y)) < CHOOSING
    if y[~left_out].min() == y[~left_out].max() or not left_out.any():
        left_out = np.zeros(len(y), bool)
    most = np.abs(x[:, :-1].T @ (y.mean() - y)).max() / len(y)
    w, tried = np.append(np.zeros(len(rules)), np.log(y.mean() / (1 - y.mean()))), []
    for share in PENALTIES:
        w = lasso(x[~left_out], y[~left_out], share * most, w)
        tried.append((log_loss(x[left_out], y[left_out], w) if left_out.any() else -share, share, w))
    _, share, w = min(tried, key=lambda r: (r[0], -r[1]))
    w = lasso(x, y, share * most, w)
    kept = np.flatnonzero(np.abs(w[:-1]) > 1e-9)
    return Ensemble([rules[k] for k in kept], [float(w[k]) for k in kept], float(w[-1]))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, max_rows: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics and labels of at most max_rows labelled ids outside fold 0, in the order of a hash of the id."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label is not null")
    known = known.where(fold_of(F.col("id"), folds) != 0).groupBy("id").agg(F.max("label").alias("label"))
    # Ids without a document take no place in the sample; equal ids take one of their texts.
    present = docs.select(docs[id_col].alias("id")).distinct()
    chosen = known.join(present, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    # At most max_rows ids and labels: small enough to be sent to every task.
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    rows = statistics(rows).toArrow()
    order = np.argsort(rows["id"].to_numpy(), kind="stable")
    table = {n: rows[n].to_numpy().astype(np.float64)[order] for n in STATISTICS}
    return table, (rows["label"].to_numpy()[order] == 1).astype(np.float64)


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, threshold: float = 0.3, max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Per row: id, held_out, score in 0..1, predicted (score >= threshold).

    Learns from at most `max_rows` labelled documents whose id is outside fold
    0 and scores every whole text; nothing but the text is read for a score.
    Null text counts as empty, whose statistics are all 0.  Null labels, null
    ids and ids without a document are not learned from; an id labelled twice
    takes the larger label, a repeated document gives one score a row.
    Without labels, or with one label only, every score is the smoothed share
    of label 1.  An empty table gives no rows; further columns are ignored.
    """
    model = fit(*sample(docs, labels, id_col, text_col, label_col, folds, max_rows))
    # Statistics that no rule reads are pruned from the plan.
    scored = statistics(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).select("id", model.score().alias("score"))
    return scored.select(
        F.col("id").alias(id_col), (fold_of(F.col("id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
