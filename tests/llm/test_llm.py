"""Each operator against plain Python on small tables, with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablewright.llm import decontamination, exact_dedup, html_template, language_model, mixing, pii, similar, simhash, substring_dedup, toxicity, warc
from tablewright.storage import scratch_path

WORDS = [a + b for a in "th an er on re at en nd".split() for b in "a e i o u ing ed ly".split()]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(120, 1)
    edited = base.split()
    edited[60] = "changed"
    return {
        1: base, 2: base, 3: " ".join(edited), 4: prose(3000, 2), 5: None, 6: "", 7: "one", 8: "one", 9: prose(30, 3) + " " + base, 10: "the  " * 60,
        11: prose(20, 4) + "\n" + prose(25, 4), 12: "A " * 9000, 13: "Ünï cödé words here",
    }


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, 1, "x") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, id long, fp string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_exact(docs, empty, texts, spark):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    groups: dict[str, list[int]] = {}
    for i, t in texts.items():
        groups.setdefault(t or "", []).append(i)
    for t, ids in groups.items():
        for i in ids:
            assert tuple(got[i])[1:] == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_dedup(empty).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    rows = exact_dedup.exact_dedup(twice).collect()
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in rows) == [(0, 2, True)] * 2 + [(1, 3, False)] + [(1, 3, True)] * 2


def pair_rows(spark, monkeypatch, docs):
    """How many pairs the near-copy search makes on the way, and how many rows go."""
    made = []
    plain = similar.similar

    def counted(pairs, *rest):
        made.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(similar, "similar", counted)
    gone = similar.near_copies(docs).count()
    monkeypatch.setattr(similar, "similar", plain)
    return sum(made), gone


def test_near_copies_cost_in_proportion(spark, monkeypatch):
    """Groups of texts that are alike, but not enough, and of true near copies: no all pairs."""
    base = prose(60, 5).split()

    def edited(n, edits, seed):
        rng = random.Random(seed)
        out = []
        for i in range(n):
            words = list(base)
            for at in rng.sample(range(60), edits):
                words[at] = f"w{i}x{at}"
            out.append((i, " ".join(words)))
        return spark.createDataFrame(out, "doc_id long, text string")

    for size in (200, 400, 800):
        pairs, gone = pair_rows(spark, monkeypatch, edited(size, 2, size))
        assert pairs <= 2 * size and gone <= pairs
    pairs, gone = pair_rows(spark, monkeypatch, edited(400, 1, 1))
    assert pairs <= 400 * 40


def test_near_copies_miss_no_similar_pair(spark):
    """Bands of min-hashes named none of the first two pairs, whose similarity is 4 / 5."""
    texts = ["w627 w511 w541 w130 w497 w624 w168 w53 w433", "w417 w742 w340 w801 w252 w338 w95 w509 w3"]
    rows = [(10 * i + j, t.rsplit(" ", j)[0]) for i, t in enumerate(texts) for j in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in similar.near_copies(docs).collect()} == {1, 11}


def test_any_order_of_shingles_names_every_similar_pair():
    rng = np.random.default_rng(3)
    close = 0
    for i in range(3000):
        common = np.zeros(similar.COUNTERS, np.uint8) if i % 2 else rng.integers(0, 9, similar.COUNTERS, np.uint8) if i % 500 == 0 else common
        n, least = int(rng.integers(1, 60)), (0.5, 0.8, 0.9)[i % 3]
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.append(a[: max(1, round(n * rng.uniform(least, 1)))], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)))
        x, y = (similar.prefix_keys(v, common, least) for v in (a, b))
        assert len(x) <= (1 - least) * len(a) + 1 + 1e-6
        if similar.similarity(a, b) >= least:
            close += 1
            assert set(x.tolist()) & set(y.tolist())
    assert close > 500


def test_common_shingles_make_no_keys(spark):
    """A passage that all texts hold is in no key, since each has enough shingles of its own."""
    passage = prose(40, 77)
    docs = spark.createDataFrame([(f"{prose(40, 7000 + i)} {passage}",) for i in range(60)], "text string")
    common = similar.commonness(docs.select(F.col("text").cast("binary")).repartition(3), 5)
    seen = Counter()
    for row in docs.collect():
        own = similar.shingles(similar.WordHashes().array(row.text.encode().lower().split()), 5)
        seen.update(similar.prefix_keys(own, common, 0.8).tolist())
    assert max(seen.values()) < 5 and len(seen) > 60 * 10


def test_sketches_rule_out_no_similar_pair(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        n, differ = int(rng.integers(1, 400)), rng.random() * 0.3
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.append(a[rng.random(n) >= differ], rng.integers(0, 1 << 62, int(n * differ * rng.random())).astype(np.uint64))
        if len(b):
            a, b = np.unique(a), np.unique(b)
            rows.append((i, similar.similarity(a, b), len(a), len(b), similar.parity_sketch(a).tolist(), similar.parity_sketch(b).tolist()))
    df = spark.createDataFrame(rows, "i int, j double, n int, m int, a array<long>, b array<long>")
    x = df.select("i", "j", F.col("n").alias("size"), *[F.col("a")[k].alias(f"s{k}") for k in range(similar.SKETCH)]).alias("x")
    y = df.select("i", F.col("m").alias("size"), *[F.col("b")[k].alias(f"s{k}") for k in range(similar.SKETCH)]).alias("y")
    found = x.join(y, "i").select("j", similar.may_be_similar("x", "y", 0.8).alias("may")).collect()
    assert all(r.may for r in found if r.j >= 0.8) and sum(not r.may for r in found) > 20


def test_quotient_filters_are_lossless():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 1 << 58, 3000, dtype=np.uint64))
    counts = rng.integers(1, 5, len(values))
    back = exact_dedup.decode(exact_dedup.encode(3, values, counts, 58), 58)
    assert (back[0] == values).all() and (back[1] == counts).all()
    one = exact_dedup.decode(exact_dedup.encode(0, values[:1], counts[:1], 58), 58)
    assert one[0][0] == values[0]


def slow_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_simhash(docs, empty, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: slow_fingerprint(t or "") for i, t in texts.items()}
    label = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            label[i] = min(label[j] for j in texts if bin(prints[i] ^ prints[j]).count("1") <= 2)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", label[i]) for i in texts}
    assert simhash.near_duplicates(empty).count() == 0


def test_links_and_components_equal_brute_force(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    points = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(12)} | set(seeds)
    ids = {p: i for i, p in enumerate(sorted(points))}
    frame = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for p, i in ids.items()], "id long, fp long")
    got = {tuple(sorted(r)) for r in simhash.links(frame).collect()}
    want = {(ids[a], ids[b]) for a in points for b in points if ids[a] < ids[b] and bin(a ^ b).count("1") <= 2}
    assert got == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    labels = {r.node: r.component for r in simhash.connected(chain).collect()}
    assert labels == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_substrings(docs, empty, texts):
    seen, want = set(), {}
    for i in sorted(texts):
        words = (texts[i] or "").encode().split()
        gone = np.zeros(len(words), bool)
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                gone[s : s + 20] = True
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        want[i] = (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode())
    assert {r.doc_id: tuple(r)[1:] for r in substring_dedup.substring_dedup(docs).collect()} == want
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_language_model(docs, empty, texts):
    got = {r.doc_id: r for r in language_model.class_ngrams(docs).collect()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    split = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    c = Counter(w for i in train for w in split[i])
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, words in split.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(words) + 1, sum(c[w] > 0 for w in words) + 1, n)
        base = sum(log10((c[w] + 1) / (n + v + 1)) for w in words) + log10((len(train) + 1) / (n + v + 1))
        assert r.base_score == pytest.approx(base) and np.isfinite(r.score) and r.score < 0
    assert language_model.class_ngrams(empty).count() == 0


def test_no_single_exchange_gains_likelihood():
    counts = np.random.default_rng(4).integers(0, 40, (11, 11)).astype(float)

    def likelihood(of):
        onto = np.zeros((11, of.max() + 1))
        onto[np.arange(11), of] = 1
        between = onto.T @ counts @ onto
        xlogx = lambda v: (v * np.log(np.maximum(v, 1))).sum()
        return xlogx(between) - xlogx(between.sum(0)) - xlogx(between.sum(1))

    of = language_model.exchange(counts, 9, 3, 50)
    assert list(of[9:]) == [3, 4]
    for word in range(9):
        for other in range(3):
            moved = of.copy()
            moved[word] = other
            assert likelihood(moved) <= likelihood(of) + 1e-6


@pytest.mark.parametrize("head", [0, 12, 1 << 18])
def test_class_scores_as_plain_python(docs, texts, head, monkeypatch):
    """Classes of frequent and joined words alike give the bigrams, the divisors and the scores."""
    made, fit = [], language_model.fit

    def kept(*args):
        model, lexicon = fit(*args)
        made.append((model, lexicon.collect()))
        return model, lexicon

    monkeypatch.setattr(language_model, "HEAD_WORDS", head)
    monkeypatch.setattr(language_model, "CLUSTERED", 6)
    monkeypatch.setattr(language_model, "fit", kept)
    got = {r.doc_id: r.score for r in language_model.class_ngrams(docs).collect()}
    model, lexicon = made[0]
    classes = len(model.below)
    of = {bytes(r["word"]): r["class"] for r in lexicon} | dict(zip(model.words, model.class_of.tolist()))
    split = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in split[i])
    assert {bytes(r["word"]): r["c"] for r in lexicon} == {w: n for w, n in c.items() if w not in set(model.words)}
    assert set(of) == set(c) and set(of.values()) <= set(range(classes))
    between = np.zeros((classes + 1, classes + 1))

    def states(words):
        return [classes, *[of.get(w, model.unseen[language_model.suffix_class(w)]) for w in words], classes]

    for i in train:
        seq = states(split[i])
        np.add.at(between, (seq[:-1], seq[1:]), 1)
    share = (between.sum(0) + 1) / (between.sum() + classes + 1)
    step = np.log10((between + language_model.PRIOR * share) / (between.sum(1, keepdims=True) + language_model.PRIOR))
    mass = [sum(n for w, n in c.items() if of[w] == k) + language_model.ADDED * (sum(of[w] == k for w in c) + (k in model.unseen)) for k in range(classes)]
    for i, words in split.items():
        seq = states(words)
        want = sum(step[a, b] for a, b in zip(seq, seq[1:])) + sum(log10((c[w] + language_model.ADDED) / max(mass[k], language_model.ADDED)) for w, k in zip(words, seq[1:]))
        assert got[i] == pytest.approx(want)


def test_words_of_many_texts_as_one_by_one():
    import pyarrow as pa

    texts = [b" aB\x0bC\x0c d\x85E \xff\xfe ", b"", b"  ", b"x", "Ä\u00a0Ö\u2003ü ÉA\x1cb".encode(), b"a b\r\nA"]
    want = [t.lower().split() for t in texts]
    for first in (0, 2):
        words, counts = language_model.split_words(pa.array(texts, pa.binary()).slice(first))
        assert words.to_pylist() == sum(want[first:], []) and counts.tolist() == [len(w) for w in want[first:]]
        assert language_model.suffix_classes(words.slice(1)).tolist() == [language_model.suffix_class(w) for w in words.to_pylist()[1:]]
    head = pa.array([b"b", b"a"], pa.binary())
    assert language_model.word_ids(pa.array([b"a", b"zz", b"b"], pa.binary()), head).tolist() == [1, 2 + language_model.suffix_class(b"zz"), 0]


def test_texts_are_cut_into_pieces_without_loss(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(language_model, "TEXT_BYTES", 10)
    texts = [b"", b"a" * 25, b"b" * 4, b"c" * 6, b"d", b"", b"e" * 9]
    pieces = [p.column(0).to_pylist() for p in language_model.texts_at_once([pa.record_batch([pa.array(texts, pa.binary())], names=["text"])])]
    assert sum(pieces, []) == texts and all(len(p) == 1 or sum(map(len, p)) <= 10 for p in pieces) and len(pieces) < len(texts)


def test_best_classes_as_word_by_word():
    """Gains that are looked up, and those that are not, choose the classes of the plain sum."""
    rng = np.random.default_rng(5)
    between, classes, chosen = rng.integers(300, 900, (7, 7)).astype(float), 4, []
    words = [(np.sort(rng.choice(14, rng.integers(1, 9), False)), own) for own in (0, 1, 2, 3, 4) for _ in range(30)]
    counts = [rng.choice([1, 2, language_model.SMALL, language_model.SMALL + 1, 40], len(code)).astype(float) for code, _ in words]
    cells, sums = np.concatenate([between[:classes].T, between[:, :classes]]), (between[:classes].sum(1), between[:, :classes].sum(0))
    grown = lambda x, n: language_model.xlogx(x + n) - language_model.xlogx(x)
    for (code, own), n in zip(words, counts):
        gain = []
        for k in range(classes):
            gain.append(sum(grown(cells[c, k] - (k == own) * m, m) for c, m in zip(code, n)))
            for total, side in zip(sums, (code < 7, code >= 7)):
                gain[-1] -= grown(total[k] - (k == own) * n[side].sum(), n[side].sum())
        chosen.append(int(np.argmax(gain)))
    starts = np.cumsum([0] + [len(c) for c, _ in words[:-1]])
    args = np.concatenate([c for c, _ in words]), np.concatenate(counts), starts, np.array([o for _, o in words]), between, classes
    assert language_model.runs_of_words(*args).tolist() == chosen


def test_bigrams_are_counted_once_for_every_set_of_classes(docs, monkeypatch):
    calls, counted = [], language_model.bigram_counts
    monkeypatch.setattr(language_model, "bigram_counts", lambda *args: calls.append(args[2]) or counted(*args))
    monkeypatch.setattr(language_model, "CLUSTERED", 6)
    assert language_model.class_ngrams(docs).count() == docs.count()
    assert len(calls) == 4  # the first words, each half of the words, all others


@pytest.mark.parametrize("head", [560, 1 << 18])
def test_rare_words_are_clustered_by_their_neighbours(spark, head, monkeypatch):
    """Words past the 512 most frequent get classes of their own accord, whatever their letters."""
    rng = random.Random(7)
    common = [f"{kind}{i}" for kind in "pq" for i in range(280)]
    rare = {kind: [f"{kind}rare{i}same" for i in range(60)] for kind in "pq"}

    def line(kind, word):
        return " ".join([rng.choice(common[:280] if kind == "p" else common[280:]) for _ in range(6)] + [word] + [rng.choice(common[:280] if kind == "p" else common[280:]) for _ in range(6)])

    rows = [(i, line("pq"[i % 2], rare["pq"[i % 2]][i // 2 % 60])) for i in range(2400)]
    held = [i for i in range(5000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2][:400]
    for a, b in zip(held[::2], held[1::2]):
        kind, n = rng.choice("pq"), rng.randrange(60)
        fits = line(kind, rare[kind][n])
        rows += [(a, fits), (b, fits.replace(rare[kind][n], rare["q" if kind == "p" else "p"][n]))]
    monkeypatch.setattr(language_model, "HEAD_WORDS", head)
    got = {r.doc_id: r.score for r in language_model.class_ngrams(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    better = [got[a] > got[b] + 0.1 for a, b in zip(held[::2], held[1::2])]
    assert np.mean(better) > 0.9


def test_toxicity_training_beats_its_start(spark):
    folder = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    texts, labels = toxicity.sample(docs, marks, "doc_id", "text", "toxic", 5, 8192, 4096)
    held = [(r.text.encode(), r.toxic) for r in docs.join(marks, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]

    def auc(epochs):
        model = toxicity.train(texts, labels, epochs)
        margins = toxicity.WordMargins(model.margins().astype(np.float32))
        scores = list(toxicity.scores([t for t, _ in held], margins, float(model.bias[1] - model.bias[0])))
        good, bad = [s for s, (_, y) in zip(scores, held) if y], [s for s, (_, y) in zip(scores, held) if not y]
        return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])

    assert auc(0) < 0.65 and auc(toxicity.EPOCHS) > 0.88


def test_subwords_as_plain_python():
    words = ["Idiot!!".encode(), b"a", b"...", "größe".encode(), b"\xff\xfe", b"the", b"the"]
    found = toxicity.Subwords.of(words)
    margins = np.random.default_rng(0).normal(0, 1, toxicity.BUCKETS)
    means = found.means(margins)
    assert means[5] == means[6] and toxicity.Subwords.of([b"idiot"]).means(margins)[0] == pytest.approx(means[0])
    for k, word in enumerate(words):
        alone = toxicity.Subwords.of([word])
        text = word.decode("utf-8", "replace").lower()
        size = len(f"<{text.strip(toxicity.EDGES) or text}>")
        assert alone.sizes[0] == 1 + sum(max(size - n + 1, 0) for n in toxicity.GRAMS)
        buckets = alone.buckets[alone.buckets < toxicity.BUCKETS]
        assert len(buckets) == alone.sizes[0] and means[k] == pytest.approx(margins[buckets].mean(), rel=1e-4, abs=1e-5)
    handed = found.spread(np.arange(7.0))
    assert handed.sum() == pytest.approx(21) and toxicity.Subwords.of([]).means(margins).size == 0


def test_toxicity_learns_unseen_spellings(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = prose(40, i + 10).split()
        if i % 4 == 0:
            words[rng.randrange(40)] = "grobian" + rng.choice(WORDS)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (7777, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.9
    assert got[900].score == got[901].score and all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in toxicity.clean(docs, marks).collect()} == {i for i, r in got.items() if r.predicted == 0}
    assert {r.score for r in toxicity.toxicity(docs.limit(3), marks.limit(0)).collect()} == {0.5}


def test_personal_data(spark):
    texts = {
        1: "write to a.b@c.example.com, +1 (212) 555-0100", 2: "1.2.3.4 and 256.1.1.1", 3: "4111 1111 1111 1111 or 4111 1111 1111 1112",
        4: None, 5: "", 6: "é" * 3 + "x@y.zz" + "7" * 30_000, 7: "a@b.c_d@e.f", 8: "call (212) 555-0100",
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, found string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    bases = {1: "email:9:26,phone:28:45", 2: "ip:0:7", 3: "card:0:19", 4: "", 5: ""}
    for i in (1, 2, 3, 4, 5):
        assert got[i].base_sha256 == hashlib.sha256(bases[i].encode()).hexdigest()
        assert set(filter(None, bases[i].split(","))) <= set(got[i].spans.split(","))
    assert (got[7].n_email, got[6].n_email, got[6].n_card) == (2, 1, 0)
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_archives_round_trip(spark):
    bodies = {1: "<p>x</p>", 2: "<p>x</p>", 3: None, 4: "", 5: "a\r\n\r\nWARC/1.1\r\nb\r\n\r\n", 6: "é\r\n" * 2000, 7: "\r\n\r\n\r\n"}
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", b, "y") for i, b in bodies.items()] + [(8, None, "z", "y")], "page_id long, url string, html string, kind string")
    path = scratch_path(spark, "archives")
    warc.write_archives(pages, path)
    captures = warc.assemble(warc.read_archives(spark, path))
    got = {int(r.page): r for r in warc.resolved(captures).collect()}
    for i, b in {**bodies, 8: "z"}.items():
        data = (b or "").encode()
        top = max(j for j, other in {**bodies, 8: "z"}.items() if (other or "") == (b or ""))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), digest)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if top == i else ("revisit", str(top)))
    shown = captures.where("response.target_uri = 'http://h.example/5'").first()
    assert shown.response.payload.decode() == bodies[5] and shown.request.kind == "request" and (shown.n_requests, shown.n_metadata) == (1, 1)


def test_archives_keep_repeated_pages(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (2, "u", "same"), (3, "v", "own"), (None, None, None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = scratch_path(spark, "archives")
    warc.write_archives(pages, path)
    captures = warc.assemble(warc.read_archives(spark, path))
    assert sorted((r.n_responses, r.n_requests, r.n_metadata) for r in captures.collect()) == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 1)]
    got = sorted(((r.page, r.record_type, r.refers_to, r.payload_bytes) for r in warc.resolved(captures).collect()), key=repr)
    want = [("1", "revisit", "2", 4)] * 2 + [("2", "response", None, 4)] * 3 + [("3", "response", None, 3)] + [(None, "response", None, 0)] * 2
    assert got == sorted(want, key=repr)
    nothing = scratch_path(spark, "archives")
    warc.write_archives(pages.limit(0), nothing)
    assert warc.resolved(warc.assemble(warc.read_archives(spark, nothing))).count() == 0


def test_main_text(spark):
    def page(i, body, host="h.example"):
        html = f'<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li>menu</ul></nav><div class="ad">buy</div><article><h1>Head {i}</h1>{body}</article><footer>foot</footer></body></html>'
        return (i, f"http://{host}/{i}", html, "x")

    rows = [page(i, f"<p>First  &amp; {i}<p>Second<br>line</p>") for i in range(6)] + [page(9, "<p>Lone</p>", "lone.example"), (10, None, None, "x"), (11, "u", "", "x"), (12, "http://o.example/", "<p>only <b>text</b></p>", "x")]
    got = {r.page_id: r for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert got[3].text == "Head 3\nFirst & 3\nSecond line" and got[3].n_chars == len(got[3].text)
    assert (got[9].text, got[10].text, got[11].text, got[12].text) == ("Head 9\nLone", "", "", "only text")


def test_main_text_beside_the_body_wrapper(spark):
    layouts = {
        "wrapped.example": '<article><h1>Head {i}</h1><p>Lead {i}</p><div class="body"><p>{a}</p><p>{b}</p></div><ul><li>Item {i}</ul></article>',
        "single.example": "<article><h1>Head {i}</h1><p>{a}</p></article>",
        "plain.example": '<div class="post"><h1>Head {i}</h1><p>Lead {i}</p><div class="text"><p>{a}</p><p>{b}</p></div></div>',
    }
    rows, want = [], {}
    for host, layout in layouts.items():
        for i in range(6):
            a, b = prose(60, i), prose(40, 100 + i)
            html = f"<html><body><nav><ul><li>menu</ul></nav>{layout.format(i=i, a=a, b=b)}<footer>foot</footer></body></html>"
            rows.append((len(rows), f"http://{host}/{i}", html))
            lines = {"wrapped.example": [f"Lead {i}", a, b, f"Item {i}"], "single.example": [a], "plain.example": [f"Lead {i}", a, b]}[host]
            want[len(rows) - 1] = "\n".join([f"Head {i}", *lines])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_template.extract(pages).collect()} == want


def test_contamination(spark):
    items = {1: prose(40, 50), 2: prose(35, 51), 3: "Short one here", 4: None}
    edited = items[1].split()
    edited[5], edited[20] = "other", "else"
    del edited[30]
    texts = {1: prose(80, 60) + " " + items[1].upper() + " " + prose(80, 61), 2: prose(50, 62) + " " + " ".join(edited), 3: prose(200, 63), 4: None, 5: "", 6: items[2], 7: "so: short, one here!"}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, item long")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminations(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 2), (7, 3)}
    assert (got[1, 1].score, got[1, 1].start_word, got[1, 1].end_word) == (1.0, 80, 120)
    assert decontamination.contaminations(docs, bench.limit(0)).count() == 0


def test_contamination_by_edited_copies_alone(spark):
    item = prose(40, 70).split()
    item[17] = "unchanged"
    edited = " ".join(item[:17] + ["altered"] + item[18:])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for n_docs, copies in ((400, range(7, 8)), (3000, range(0, 3000, 3))):
        texts = {i: prose(20, 5000 + i) + (" " + edited + " " if i in copies else " ") + prose(20, 9000 + i) for i in range(n_docs)}
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
        assert {r.doc_id for r in decontamination.contaminations(docs, bench).collect()} == set(copies)


def test_mixing_meets_its_targets(spark):
    kinds = {"a": WORDS[:20], "b": WORDS[20:40]}
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(kinds["ab"[i % 3 == 0]]) for _ in range(rng.randrange(5, 60))), "ab"[i % 3 == 0]) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "", None)], "doc_id long, text string, rate string")
    labelled = spark.createDataFrame([(k, t) for _, t, k in rows[:60]], "domain string, text string")
    got = mixing.mix(docs, labelled, {"a": 1.0, "b": 3.0}).collect()
    total = sum(r.tokens for r in got)
    by = Counter()
    for r in got:
        p = {r.domain: r.posterior, "ab".replace(r.domain, ""): 1 - r.posterior}
        for k, v in p.items():
            by[k] += r.rate * r.tokens * v
    assert len(got) == 302 and min(r.rate for r in got) >= 0
    assert by["a"] / total == pytest.approx(0.25, abs=2e-3) and by["b"] / total == pytest.approx(0.75, abs=2e-3)
    assert mixing.mix(docs.limit(0), labelled, {"a": 1.0}).count() == 0


def test_pipeline_keeps_what_each_stage_keeps(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    exact = {r.doc_id for r in exact_dedup.exact_dedup(docs).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.exact_copies(spark, docs, folder).collect()} == exact
    out = corpus_pipeline.run(spark, folder)
    assert set(docs.columns) | {"rate"} <= set(out.columns)
    got = [r.doc_id for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) <= ids
    assert out.select(F.min("rate")).first()[0] > 0


def test_pipeline_drops_near_copies_as_brute_force_does(spark):
    import corpus_pipeline

    rng = random.Random(8)
    texts = {}
    for base in range(12):
        words = prose(rng.randrange(60, 400), 900 + base).split()
        for copy in range(6):
            edited = list(words)
            for _ in range(copy * len(words) // 150):
                edited[rng.randrange(len(words))] = "changed"
            texts[len(texts)] = " ".join(edited)
    hot = prose(200, 999).split()
    for i in range(150):  # one group of copies whose edits lie at the limit
        edited = list(hot)
        for _ in range(i % 7):
            edited[rng.randrange(200)] = f"new{i}"
        texts[len(texts)] = " ".join(edited)
    texts |= {len(texts): None, len(texts) + 1: "", len(texts) + 2: "only three words", len(texts) + 3: "Only THREE  words"}

    def shingle_set(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingle_set(t) for i, t in texts.items()}
    linked = [(i, j) for i in texts for j in texts if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = {i: i for i in texts}
    while any(label[i] != label[j] for i, j in linked):
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert got == {i for i in texts if label[i] == i} and len(got) < len(texts) - 100
    assert similar.near_copies(docs.limit(0)).count() == 0


def test_pipeline_sends_only_named_rows_around(spark, monkeypatch):
    """Rows that are not named, by null id or not, are not part of the join, and none of the named ones is missed."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)] + [(None, "a"), (None, "b"), (5, "other"), (6, None), (6, None)], "doc_id long, text string").repartition(3)
    named = [(5, "text 5"), (None, "b"), (6, ""), (7, "not its text"), *[(i, f"text {i}") for i in range(100, 120)]]
    gone = spark.createDataFrame([(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in named], "doc_id long, text_sha256 string")
    left = corpus_pipeline.kept(docs, gone)
    assert left.columns == docs.columns
    want = [(r.doc_id, r.text) for r in docs.collect() if (r.doc_id, r.text or "") not in named]
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.kept(docs, gone.limit(0)).count() == docs.count()
    asked = []
    plain = corpus_pipeline.may_be_among
    monkeypatch.setattr(corpus_pipeline, "may_be_among", lambda marks, mark: asked.append(plain(marks, mark)) or asked[-1])
    corpus_pipeline.kept(docs, gone)
    assert 25 <= docs.where(asked[0]).count() < 100


def test_near_copies_send_only_shared_texts_around(spark, monkeypatch):
    texts = [(i, prose(40, 5000 + i)) for i in range(300)] + [(1000 + i, prose(40, 5000) + f" end{i}") for i in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    asked = []
    plain = similar.may_be_among
    monkeypatch.setattr(similar, "may_be_among", lambda marks, mark: asked.append(plain(marks, mark)) or asked[-1])
    assert {r.doc_id for r in similar.near_copies(docs).collect()} == {1000, 1001, 1002}
    source = docs.select(F.sha2("text", 256).alias("text_sha256"))
    assert 4 <= source.where(asked[0]).count() < 100


def test_pipeline_tells_rows_of_one_id_apart(spark, tmp_path):
    import corpus_pipeline

    item = prose(40, 80)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, item), (1, prose(50, 81)), (None, prose(50, 82)), (None, item), (2, prose(50, 83)), (2, prose(50, 84)), (3, prose(50, 83)), (None, prose(50, 83))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def left(stage):
        return sorted(map(str, map(tuple, stage(spark, docs, str(tmp_path)).collect())))

    assert left(corpus_pipeline.benchmark_copies) == sorted(str(r) for r in rows if r[1] != item)
    assert left(corpus_pipeline.exact_copies) == sorted(str(rows[i]) for i in (0, 1, 2, 5, 6))
    assert left(corpus_pipeline.near_copies) == sorted(str(rows[i]) for i in (0, 1, 2, 4, 5))
