"""Near words by Gram matrices against comparison of all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.llm import spelling_variants as sv

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def slow_words(rows, least=7, twice=2):
    total = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= twice}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(rows):
    words = slow_words(rows)
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def varied(seed, words=40, rows=60):
    """Words and their misspellings, some hundreds of times as frequent as others."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéöÿÀ") for _ in range(rng.randint(6, 11))) for _ in range(words)]
    out = []
    for i in range(rows):
        text = []
        for _ in range(80):
            w = base[int(len(base) * rng.random() ** 4)]
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcx") + w[k:], w[:k] + rng.choice("abcx") + w[k + 1 :]])
            text.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_as_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(sv, "PART_WORDS", 3)  # blocks of many parts
    monkeypatch.setattr(sv, "COUNTED", 20)
    rows = varied(seed) + [(None, "Gleichnis gleichnis"), (None, "gleichnis"), (7, None), (7, ""), (9, "a1b2 kürzest × ÷×÷×÷×÷×÷ x" * 3)]
    rows += [rows[0]] * 3  # repeated in full
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = {tuple(r) for r in sv.spelling_variants(df).collect()}
    want = slow(rows)
    assert got == want
    assert any(w[1] for w in want) and any(w[4] > 3 for w in want)
    assert sv.spelling_variants(df.limit(0)).count() == 0


def test_forms_lead_on_to_the_last_one(spark):
    words = {"aaaaaaab": 3000, "aaaaaabb": 200, "aaaaabbb": 15, "aaaabbbb": 1, "aaaacbbb": 1}
    table = spark.createDataFrame([(w, f) for w, f in zip(list(words)[1:], list(words))], "word string, form string")
    assert {tuple(r) for r in sv.rooted(table).collect()} == {(w, "aaaaaaab") for w in list(words)[1:]}
    rows = sv.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), 10).groupBy("word").agg(F.sum("near").alias("near"), F.max("form").alias("form"))
    near = {r.word: (r.near, r.form) for r in rows.collect()}
    assert near["aaaaabbb"] == (3, "aaaaaabb") and near["aaaabbbb"] == (2, "aaaaabbb")


def test_ties_go_to_the_smallest_form(spark):
    words = spark.createDataFrame([("mmmmmmmm", 1), ("mmmmmmmz", 50), ("mmmmmmma", 50), ("mmmmmmm", 50)], "word string, n long")
    rows = [r for r in sv.near_words(words, 10).collect() if r.word == "mmmmmmmm" and r.form]
    assert min(rows, key=lambda r: (-r.form_n, r.form)).form == "mmmmmmm"


def test_blocks_lose_no_pair():
    rng = random.Random(5)
    groups = sv.letter_groups()
    assert sorted("".join(groups)) == sorted({chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]})

    def block(word):
        return tuple(sum(c in g for c in word) for g in groups)

    for _ in range(300):
        a = "".join(rng.choice("aeinrstéö") for _ in range(9))
        k = rng.randrange(9)
        for b in (a[:k] + a[k + 1 :], a[:k] + rng.choice("xyzü") + a[k + 1 :]):
            moved = [y - x for x, y in zip(block(a), block(b))]
            assert sorted(moved) in ([-1] + [0] * 5, [0] * 6, [-1] + [0] * 4 + [1])


def test_very_long_words(spark):
    long = "ab" * 60_000
    rows = [(1, f"{long} {long} {long}x {long}x"), (2, f"{long} {long}x {long[:-1]}c")]
    got = {r.word[-3:]: r.n_near for r in sv.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {w[0][-3:]: w[4] for w in slow(rows)}
    assert got == want
