"""Personal data by weak supervision, with DataFrame functions only.

Patterns find candidates; labelers (pattern, gazetteer, context, shape) vote
on each; expectation-maximisation over the counted vote patterns estimates how
reliable each labeler is; its posteriors train a logistic span classifier.
What the base patterns find always stays; the classifier adds other spans.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.texts import id_and_text
from tablewright.storage import cut_lineage

KINDS = ("email", "ip", "card", "phone")

# A run of local-part characters is tried once, from its start or from the end of the match before.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_FITS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser forms, which only the classifier can make spans.
LOOSE_EMAIL = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?:\(at\)|\[at\])\s?[A-Za-z0-9-]++(?:\s?(?:\(dot\)|\[dot\]|\.)\s?[A-Za-z0-9-]++)++"
LOOSE_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])"

#: Gazetteers: top-level domains, first digits of card issuers, country codes.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|eu|ch|at|us|ca|jp|cn|br|mx"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|3[068]|6"
COUNTRIES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Words before a span that speak for it.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|kontakt|courriel)",
    "ip": r"(?i)(?:\bip\b|address|addr|server|host|from|login)",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|tarjeta|karte|carte|payment)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell|whatsapp|telefon)",
}
BEFORE = 24
LABELERS = ("pattern", "gazetteer", "context", "shape")
ROUNDS, STEPS, THRESHOLD = 50, 300, 0.5


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost non-overlapping matches, in code points.

    What stands between the matches is what `split` leaves, so the places are running sums of lengths.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("value"), F.slice(between, 1, F.size(found)).alias("gap"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    size = F.length(number)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(number, size - i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10 == 0


def candidates(text: Column) -> Column:
    """All candidates of a text: array<struct<kind, start, end, value, base>>."""
    numeric = text.rlike("[0-9]")
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def of(kind: int, guard: Column, pattern: str, base, fits=None) -> Column:
        raw = F.when(guard, places(text, pattern)).otherwise(none)
        marked = F.transform(raw, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), base(s["value"]).alias("base")))
        return F.filter(marked, fits) if fits else marked

    no = lambda value: F.lit(False)
    n_digits = lambda value: F.length(digits(value))
    return F.concat(
        of(0, F.contains(text, F.lit("@")), EMAIL, lambda v: F.lit(True)),
        of(1, numeric, IP, lambda v: v.rlike(IP_FITS)),
        of(2, numeric, CARD, lambda v: F.when(n_digits(v).between(12, 19), luhn(digits(v))).otherwise(False), lambda s: n_digits(s["value"]).between(12, 19)),
        of(3, numeric & F.contains(text, F.lit("+")), PHONE, lambda v: n_digits(v).between(9, 15)),
        of(0, F.contains(F.lower(text), F.lit("at)")) | F.contains(F.lower(text), F.lit("at]")), LOOSE_EMAIL, no),
        of(3, numeric, LOOSE_PHONE, no),
    )


def by_kind(kind: Column, choices: list[Column]) -> Column:
    out = F.when(kind == 0, choices[0])
    for number, choice in enumerate(choices[1:], 1):
        out = out.when(kind == number, choice)
    return out


def voted(text: Column, span: Column) -> Column:
    """A candidate with the votes (1, -1, or 0 for none) of the labelers."""
    kind, value = span["kind"], span["value"]
    number = digits(value)
    before = F.substr(text, F.greatest(span["start"] - BEFORE + 1, F.lit(1)), F.least(span["start"], F.lit(BEFORE)))
    last, following = F.right(before, F.lit(1)), F.substr(text, span["end"] + 1, F.lit(1))
    yes = lambda test: F.when(test, 1).otherwise(-1)
    gazetteer = by_kind(
        kind,
        [
            yes(value.rlike(rf"(?i)\.\s?(?:{DOMAINS})$")),
            yes(~value.rlike(r"^0*(?:0|127|255)\.") & value.rlike(IP_FITS)),
            yes(number.rlike(f"^(?:{ISSUERS})")),
            F.when(value.startswith("+"), yes(number.rlike(f"^(?:{COUNTRIES})"))).otherwise(0),
        ],
    )
    glued = last.rlike("[A-Za-z0-9]") | following.rlike("[A-Za-z0-9]")
    context = F.when(by_kind(kind, [before.rlike(CUES[k]) for k in KINDS]), 1).when(glued, -1).otherwise(0)
    size = F.length(number)
    shape = by_kind(kind, [yes(~value.rlike(r"\.\.|^\.|\.@")), yes(value.rlike(IP_FITS)), yes(size.isin(13, 15, 16) & span["base"]), yes(size.between(10, 13))])
    pattern = yes(span["base"])
    votes = {"pattern": pattern, "gazetteer": gazetteer, "context": context, "shape": shape}
    return F.struct(
        kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["base"].alias("base"), *[votes[n].cast("int").alias(n) for n in LABELERS]
    )


def reliabilities(patterns: list[tuple]) -> tuple[np.ndarray, dict]:
    """Posterior of every counted vote pattern (kind, votes..., count), and what the labelers are worth.

    Expectation-maximisation with a prior per kind and, for each labeler and
    kind, the chance of every vote given a true and given a false span.
    """
    kinds = np.array([p[0] for p in patterns])
    votes = np.array([p[1:-1] for p in patterns]) + 1
    count = np.array([p[-1] for p in patterns], float)
    prior = np.full(len(KINDS), 0.5)
    chance = np.tile(np.array([[0.5, 0.3, 0.2], [0.15, 0.3, 0.55]]), (len(KINDS), votes.shape[1], 1, 1))  # kind, labeler, truth, vote
    posterior = np.zeros(len(patterns))
    for _ in range(ROUNDS):
        logs = np.log(np.stack([1 - prior[kinds], prior[kinds]], 1))
        for j in range(votes.shape[1]):
            logs += np.log(chance[kinds, j][np.arange(len(kinds)), :, votes[:, j]])
        posterior = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -30, 30)))
        for k in range(len(KINDS)):
            own = kinds == k
            weight = count * own
            prior[k] = (weight @ posterior + 1) / (weight.sum() + 2)
            for j in range(votes.shape[1]):
                for truth, share in ((0, 1 - posterior), (1, posterior)):
                    seen = np.bincount(votes[:, j], weight * share, 3) + np.array([[0.5, 0.3, 0.2], [0.15, 0.3, 0.55]])[truth] * 10
                    chance[k, j, truth] = seen / seen.sum()
    return posterior, {"prior": prior, "chance": chance}


def span_classifier(patterns: list[tuple], posterior: np.ndarray) -> np.ndarray:
    """Logistic weights (kinds, then labelers) on the soft labels, by gradient steps over the counted patterns."""
    x = np.zeros((len(patterns), len(KINDS) + len(LABELERS)))
    x[np.arange(len(patterns)), [p[0] for p in patterns]] = 1
    x[:, len(KINDS) :] = np.array([p[1:-1] for p in patterns])
    weight = np.array([p[-1] for p in patterns], float)
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(x @ w))) - posterior
        w -= 1.0 * (x.T @ (weight * error) + 1e-3 * w)
    return w


def listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, then end."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and the digest are of what the base patterns find; `spans`
    also has what the classifier adds, never inside a base span.  Null and
    empty texts have no spans, repeated rows give repeated results, and
    without any candidate nothing is trained.
    """
    text = F.col("text")
    source = id_and_text(docs, id_col, text_col).withColumn("found", candidates(text))
    base = F.filter("found", lambda s: s["base"])
    apart = lambda s: s["base"] | ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    spans = F.transform(F.filter("found", apart), lambda s: voted(text, s))
    marked = cut_lineage(source.select("id", spans.alias("spans")), "pii-candidates")
    # At most 4 * 3^4 different patterns, whatever the corpus holds.
    counted = marked.select(F.inline("spans")).groupBy("kind", *LABELERS).count().collect()
    patterns = sorted(tuple(r) for r in counted)
    weights = [0.0] * (len(KINDS) + len(LABELERS))
    if patterns:
        posterior, _ = reliabilities(patterns)
        weights = [float(w) for w in span_classifier(patterns, posterior)]
    limit = math.log(THRESHOLD / (1 - THRESHOLD))

    def kept(s: Column) -> Column:
        logit = F.element_at(F.array(*map(F.lit, weights[: len(KINDS)])), s["kind"] + 1)
        for w, name in zip(weights[len(KINDS) :], LABELERS):
            logit = logit + F.lit(w) * s[name]
        return s["base"] | (logit > limit)

    final = marked.select("id", F.filter("spans", lambda s: s["base"]).alias("base"), F.filter("spans", kept).alias("all"))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    counts = [number(kind) for kind in range(len(KINDS))]
    return final.select(
        F.col("id").alias(id_col), *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"),
        (F.size("all") - F.size("base")).cast("bigint").alias("n_added"),
    )
