"""Operators against independent plain Python: base spans, alignments, posteriors and rates."""

from __future__ import annotations

import hashlib
import random
import re
from math import exp, log

import numpy as np
import pytest
import xxhash

from tablewright.llm import decontamination, mixing, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def slow_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, kind in enumerate(PATTERNS) for m in re.finditer(PATTERNS[kind], text or "") if passes(kind, m.group())]
    return sorted(found)


def test_base_spans_as_plain_patterns(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "x.y@z-1.example.com.", "@@a@b", "1.2.3.4", "256.1.1.1", "01.002.3.255.9", "4111 1111 1111 1111", "4111-1111-1111-1112", "0" * 16, "+1 (555) 123-4567", "+12", "++49 30 1234567",
            "é", "\n", " ", "12", ".", "-", "+", "🙂", "a" * 30, "378282246310005"]
    made = [(100_000 + i, "".join(rng.choice(bits) + rng.choice(["", " ", ","]) for _ in range(rng.randint(0, 25)))) for i in range(300)]
    given = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = made + given + [(-1, None), (-2, ""), (None, "a@b.c"), (made[0][0], made[0][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string").repartition(4)
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.personal_data(df).collect()), key=repr)
    want = []
    for i, text in rows:
        spans = slow_spans(text)
        named = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)
        want.append((i, *[sum(s[3] == kind for s in spans) for kind in PATTERNS], hashlib.sha256(named.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert all(sum(w[k] for w in want) > 5 for k in range(1, 5))


def slow_align(item, passage):
    """Smith-Waterman, cell by cell: the best score."""
    score = [[0.0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0.0
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            same = decontamination.MATCH if item[i - 1] == passage[j - 1] else decontamination.MISMATCH
            score[i][j] = max(0.0, score[i - 1][j - 1] + same, score[i - 1][j] + decontamination.GAP, score[i][j - 1] + decontamination.GAP)
            best = max(best, score[i][j])
    return best


def test_alignment_scores_cell_by_cell():
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.randrange(8) for _ in range(rng.randint(1, 14))]
        passage = [rng.randrange(8) for _ in range(rng.randint(1, 30))]
        if rng.random() < 0.5:
            at = rng.randrange(len(passage))
            passage[at:at] = [w for w in item if rng.random() > 0.2]
        best, end = decontamination.align(np.array(item, np.uint64), np.array(passage, np.uint64))
        assert best == pytest.approx(slow_align(item, passage))
        assert best == 0 or slow_align(item, passage[: end + 1]) == pytest.approx(best)


def test_contaminations_as_alignment_of_everything(spark):
    """Every document against every item, without seeds; those that share three words in a row and reach the score are found."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 25)))) for i in range(8)] + [(None, "w1 w2 w3 w4 w5 w6 w7"), (99, None), (98, "...")]
    docs = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            copy = [w if rng.random() > 0.15 else rng.choice(words) for w in items[i % 8][1].split()]
            text[5:5] = copy
        docs.append((i, " ".join(text).upper() if i % 2 else ", ".join(text)))
    docs += [(None, items[0][1]), (1000, items[1][1]), (1000, items[1][1]), (1001, None)]
    found = decontamination.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.doc_id, r.item_id, round(r.score, 6)) for r in found.collect()), key=repr)
    want = []
    for i, text in docs:
        own = decontamination.words_of((text or "").encode())
        for j, item in items:
            wanted = decontamination.words_of((item or "").encode())
            if j is None or not wanted:
                continue  # an item without id, or without words, matches nothing
            grams = {tuple(wanted[k : k + 3]) for k in range(len(wanted) - 2)}
            if not any(tuple(own[k : k + 3]) in grams for k in range(len(own) - 2)):
                continue
            score = slow_align(wanted, own)
            if score >= decontamination.needed(len(wanted)):
                want.append((i, j, round(score / len(wanted), 6)))
    assert got == sorted(want, key=repr) and len(want) > 15


def test_mixing_as_numpy(spark):
    rng = random.Random(11)
    vocab = {"a": ["red", "blue", "green", "the"], "b": ["one", "two", "three", "the"], "c": ["sun", "moon", "the", "one"]}
    labelled = [(d, " ".join(rng.choice(vocab[d]) for _ in range(12))) for d in "aaabbc" for _ in range(4)]
    docs = [(i, " ".join(rng.choice(vocab["aaab"[i % 4]]) for _ in range(rng.randint(0, 30))), "x") for i in range(40)] + [(40, None, "x"), (None, "red one", "y"), (3, "sun sun", "z")]
    targets = {"a": 0.2, "b": 0.5, "c": 0.3}
    got = mixing.mix(
        spark.createDataFrame(docs, "doc_id long, text string, row string"), spark.createDataFrame(labelled, "domain string, text string"), targets
    ).collect()

    def features(text):
        return [xxhash.xxh64_intdigest(w.encode(), 42) for w in (text or "").lower().split()]

    def bucket(h):
        return (h - (1 << 64) if h >> 63 else h) % mixing.FEATURES

    domains = sorted(targets)
    counts = np.zeros((3, mixing.FEATURES))
    for d, text in labelled:
        for h in features(text):
            counts[domains.index(d), bucket(h)] += 1
    logs = np.log((counts + mixing.ADDED) / (counts.sum(1, keepdims=True) + mixing.ADDED * mixing.FEATURES))
    share = np.array([sum(d == x for d, _ in labelled) for x in domains])
    prior = [log((s + mixing.ADDED) / (share.sum() + mixing.ADDED * 3)) for s in share]
    tokens = np.array([len(features(t)) for _, t, _ in docs], float)
    posterior = []
    for (_, text, _), n in zip(docs, tokens):
        own = [bucket(h) for h in features(text)]
        logit = [logs[k, own].sum() / max(n, 1) ** 0.5 + prior[k] for k in range(3)]
        weights = [exp(x - max(logit)) for x in logit]
        posterior.append([w / sum(weights) for w in weights])
    p = np.array(posterior)
    wanted = np.array([targets[d] for d in domains]) * tokens.sum()
    mass, curve = (tokens[:, None] * p).sum(0), (tokens[:, None] * p * p).sum(0)
    rate, step = np.ones(len(docs)), 1 / max(mass / curve)
    for _ in range(mixing.STEPS):
        errors = ((rate * tokens)[:, None] * p).sum(0) - wanted
        if np.abs(errors).max() <= mixing.NEAR * wanted.sum():
            break
        rate = np.maximum(0, rate - (step * errors / curve * p).sum(1))
    found = {(r.doc_id, r.row): r for r in got}
    assert len(got) == len(docs)
    for (i, _, row), n, own, r in zip(docs, tokens, p, rate):
        f = found[(i, row)]
        assert (f.tokens, f.posterior) == (n, pytest.approx(own.max()))
        assert f.domain == domains[int(own.argmax())] and f.rate == pytest.approx(r, abs=1e-6)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert mixing.mix(empty, spark.createDataFrame(labelled, "domain string, text string"), targets).count() == 0
