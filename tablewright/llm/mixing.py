"""Soft-membership mixing, with DataFrame functions only.

A labelled table trains a naive Bayes classifier on hashed words; it gives
every document a posterior over the domains.  Projected gradient steps then
fit a nonnegative rate for each document, so that the expected tokens of the
domains, rate * tokens * posterior summed over documents, meet the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.storage import cut_lineage

#: Hashed word features; with at most MAX_DOMAINS domains the model has a fixed size and goes to every task.
FEATURES, MAX_DOMAINS = 4096, 64
#: Labelled rows the classifier is fitted on, taken in the order of a hash of the id.
MAX_ROWS = 8192
ADDED = 1.0
#: Gradient steps, the relative error that is near enough, and the steps between two written tables.
STEPS, NEAR, WRITE_EVERY = 60, 1e-4, 10


def word_rows(docs: DataFrame) -> DataFrame:
    """The columns but `text`, and one row per word with its place `at` and `feature`; a text without words has one row with null."""
    words = F.split(F.lower("text"), r"[\x20\x09-\x0D]+")
    rows = docs.select(*[c for c in docs.columns if c != "text"], F.posexplode(words).alias("at", "word"))
    return rows.select(*[c for c in rows.columns if c != "word"], F.when(F.col("word") != "", F.pmod(F.xxhash64("word"), F.lit(FEATURES))).alias("feature"))


def model_of(labelled: DataFrame, domains: list[str]) -> DataFrame:
    """(feature, l0, l1, ...): log P(feature | domain); labelled has domain and text.  FEATURES rows."""
    counts = word_rows(labelled).where("feature is not null").groupBy("feature").pivot("domain", domains).count()
    every = labelled.sparkSession.range(FEATURES).withColumnRenamed("id", "feature").join(counts, "feature", "left").fillna(0)
    every = cut_lineage(every.select("feature", *[F.col(f"`{d}`").cast("double").alias(f"n{i}") for i, d in enumerate(domains)]), "feature-counts")
    totals = every.agg(*[F.sum(f"n{i}") for i in range(len(domains))]).first()
    return every.select("feature", *[F.log((F.col(f"n{i}") + ADDED) / F.lit(float(totals[i] or 0) + ADDED * FEATURES)).alias(f"l{i}") for i in range(len(domains))])


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """docs (row, id, text) -> (row, id, copies, tokens, p0, p1, ...); `copies` rows of one id and row are one text.

    The evidence is divided by the root of the document's length, so words
    that depend on each other do not make every posterior 0 or 1.
    """
    n = len(domains)
    shares = {r[0]: r[1] for r in labelled.groupBy("domain").count().collect()}  # one row per domain
    total = sum(shares.values())
    prior = [F.log(F.lit((shares.get(d, 0) + ADDED) / (total + ADDED * n))) for d in domains]
    model = F.broadcast(model_of(labelled, domains))  # FEATURES rows of at most MAX_DOMAINS numbers
    sums = (
        word_rows(docs)
        .join(model, "feature", "left")
        .groupBy("row", "id")
        .agg(
            F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("copies"), F.count("feature").alias("tokens"), *[F.coalesce(F.sum(f"l{i}"), F.lit(0.0)).alias(f"l{i}") for i in range(n)]
        )
        .select("row", "id", "copies", (F.col("tokens") / F.col("copies")).cast("bigint").alias("tokens"), *[(F.col(f"l{i}") / F.col("copies")).alias(f"l{i}") for i in range(n)])
    )
    scale = F.sqrt(F.greatest(F.col("tokens"), F.lit(1)))
    logits = sums.select("row", "id", "copies", "tokens", *[(F.col(f"l{i}") / scale + prior[i]).alias(f"l{i}") for i in range(n)])
    top = F.greatest(*[F.col(f"l{i}") for i in range(n)]) if n > 1 else F.col("l0")
    weights = logits.select("row", "id", "copies", "tokens", *[F.exp(F.col(f"l{i}") - top).alias(f"w{i}") for i in range(n)])
    whole = sum((F.col(f"w{i}") for i in range(1, n)), F.col("w0"))
    return weights.select("row", "id", "copies", "tokens", *[(F.col(f"w{i}") / whole).alias(f"p{i}") for i in range(n)])


def fitted_rates(members: DataFrame, targets: list[float]) -> DataFrame:
    """Adds `rate` >= 0 to (..., copies, tokens, p0, p1, ...), by projected gradient steps from rate 1.

    Minimises the squared domain errors, each over the domain's own curvature.
    A step is one aggregate of as many sums as there are domains, and the
    rates follow from those sums row by row, so nothing is shuffled.
    """
    n = len(targets)
    p = [F.col(f"p{i}") for i in range(n)]
    weight = F.col("tokens") * F.col("copies")
    first = members.agg(*[F.sum(weight * c) for c in p], *[F.sum(weight * c * c) for c in p]).first()
    mass, curve = [float(v or 0) for v in first[:n]], [float(v or 0) for v in first[n:]]
    table = members.withColumn("rate", F.lit(1.0))
    held = [i for i in range(n) if curve[i] > 0]
    if not held:
        return table
    step = 1 / max(mass[i] / curve[i] for i in held)
    scale = sum(targets) or 1.0
    for number in range(1, STEPS + 1):
        reached = table.agg(*[F.sum(F.col("rate") * weight * p[i]) for i in held]).first()
        errors = [float(got or 0) - targets[i] for got, i in zip(reached, held)]
        if max(abs(e) for e in errors) <= NEAR * scale:
            break
        down = sum((F.lit(step * e / curve[i]) * p[i] for e, i in zip(errors, held)), F.lit(0.0))
        table = table.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - down))
        if number % WRITE_EVERY == 0:
            table = cut_lineage(table, "rates")
    return table


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, domain: Column, max_rows: int) -> DataFrame:
    """(domain, text) of at most max_rows labelled documents; `domain` is of columns of docs joined with labels."""
    known = labels.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)  # few and narrow enough for every task
    extra = [c for c in labels.columns if c not in docs.columns]
    joined = docs.join(F.broadcast(chosen.select(id_col, *extra)), id_col)
    return joined.select(domain.cast("string").alias("domain"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("domain is not null")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: all its columns, tokens, domain (the likeliest), posterior (its share), rate.

    `targets` are weights of domains, of any sum; their tokens are shares of
    the tokens docs has.  Labelled domains without a target get none of the
    tokens.  Null and empty texts have no tokens, the prior as posterior, and
    a rate like any other; repeated rows have equal rates.  Columns of docs
    named like an added one give way to it.  No labelled rows: the posterior
    is even.  No rows: no result.
    """
    labelled = cut_lineage(labelled, "labelled")
    seen = {r[0] for r in labelled.select("domain").distinct().limit(MAX_DOMAINS + 1).collect()}
    domains = sorted(seen | set(targets))
    if len(domains) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    # Id and text hash name a text: unlike row numbers they are the same in every pass.
    whole_text = F.coalesce(docs[text_col], F.lit(""))
    numbered = docs.withColumn("_row", F.xxhash64(whole_text))
    source = numbered.select(F.col("_row").alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    members = cut_lineage(posteriors(source, labelled, domains), "memberships")
    tokens = members.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    whole = sum(targets.values()) or 1.0
    rated = fitted_rates(members, [tokens * targets.get(d, 0.0) / whole for d in domains])
    shares = F.array(*[F.struct(F.col(f"p{i}").alias("p"), F.lit(-i).alias("at"), F.lit(d).alias("domain")) for i, d in enumerate(domains)])
    best = F.array_max(shares)
    facts = rated.select(F.col("row").alias("_hash"), F.col("id").alias("_id"), "tokens", best["domain"].alias("domain"), best["p"].alias("posterior"), "rate")
    own = [c for c in numbered.columns if c not in ("tokens", "domain", "posterior", "rate")]
    return numbered.select(own).join(facts, (F.col("_row") == F.col("_hash")) & F.col(id_col).eqNullSafe(F.col("_id"))).drop("_row", "_hash", "_id")
