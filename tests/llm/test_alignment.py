"""Alignment of two tokenizers against one that looks at every pair of tokens."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from tablewright.llm import token_alignment as ta

A, B = f"{ta.TOKENIZERS}/{ta.BYTE_BPE}", f"{ta.TOKENIZERS}/{ta.PIECE_BPE}"


def spans(pieces):
    at, out = 0, []
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def slow_text(text):
    """(n_a, n_b, n_groups, links, digest) of a text encoded whole, or None."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not text:
        return None
    a, b = ta.side("byte", A), ta.side("piece", B)
    encoder = Tokenizer.from_file(A)
    encoder.encode_special_tokens = True
    ids_a = encoder.encode(" " + text, add_special_tokens=False).ids
    ids_b = SentencePieceProcessor(model_file=B).encode(text)
    bytes_a, bytes_b, whole = [a.pieces[i] for i in ids_a], [b.pieces[i] for i in ids_b], (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    at_a, at_b = spans(bytes_a), spans(bytes_b)
    links = [(i, j) for (s, e), i in zip(at_a, ids_a) for (u, v), j in zip(at_b, ids_b) if s < v and u < e]
    shared = sorted({e for _, e in at_a} & {e for _, e in at_b})
    groups, start = [], 0
    for end in shared:
        left = [str(i) for (s, e), i in zip(at_a, ids_a) if start < e <= end]
        right = [str(i) for (s, e), i in zip(at_b, ids_b) if start < e <= end]
        groups.append(",".join(left) + "|" + ",".join(right))
        start = end
    return len(ids_a), len(ids_b), len(shared), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def texts():
    rng = random.Random(2)
    words = ["the", "ther", "Zürich", "naïve", "日本語", "don't", "x" * 90, "1234567", "á", "🙂", "<|endoftext|>", "</s>", "<0x41>", "foo.bar", "\x1c", " ", "　"]
    gaps = [" ", "  ", "\n", "\n\n", " \n ", "\t", "   ", "\r\n", "  "]
    made = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(30)) for _ in range(12)]
    return [*made, "", None, " ", "  ", "\n", "a", " a", "a ", "a  ", "a \n", "▁", "a ▁ b", "a▁ b", "\x00", "a\x00 b", "word " * 400, "n" * 3000]


@pytest.fixture(scope="module")
def corpus():
    rows = list(enumerate(texts()))
    return [*rows, (0, rows[0][1]), (None, rows[1][1]), (500, rows[1][1]), (None, None)]


def test_alignment_as_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(ta, "BATCH_TEXTS", 3)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in corpus], "doc_id long, text string, pair string, sha int").repartition(3)
    slow = {t: slow_text(t) for _, t in corpus}
    counts, best = Counter(), defaultdict(int)
    for _, t in corpus:
        counts.update(slow[t][3] if slow[t] else [])
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = []
    for i, t in corpus:
        if slow[t] is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, digest = slow[t]
            want.append((i, n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    assert sum(w[1] > 0 for w in want) > 20 and sum(w[1] == 0 for w in want) > 4
    for bound in (ta.SENT_PAIRS, 0):  # pairs sent to the tasks, and joined by a shuffle
        monkeypatch.setattr(ta, "SENT_PAIRS", bound)
        measures, pairs = ta.token_alignment(df)
        assert sorted(map(tuple, measures.collect()), key=repr) == sorted(want, key=repr)
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == dict(counts)
    assert all(r.best == (r["count"] == best[r.b]) for r in pairs.collect())


def test_alignment_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    measures, pairs = ta.token_alignment(df)
    assert measures.count() == pairs.count() == 0


def test_a_hot_text_keeps_every_row(spark):
    rows = [(i % 40, "a hot text") for i in range(600)] + [(i, f"text {i}") for i in range(100)] + [(i, "") for i in range(300)]
    measures, _ = ta.token_alignment(spark.createDataFrame(rows, "doc_id long, text string"))
    got = measures.collect()
    assert len(got) == 1000 and sum(r.groups_sha256 == "" for r in got) == 300
    assert len({tuple(r)[1:] for r in got if r.n_a and r.count_sum == max(x.count_sum for x in got)}) == 1


def test_remembered_stretches_change_nothing(monkeypatch):
    a, b = ta.side("byte", A), ta.side("piece", B)
    some = [t for t in texts() if t]
    fresh = [list(ta.aligned(ta.Stretches(a, b), [t]))[0][:5] for t in some]
    monkeypatch.setattr(ta, "REMEMBERED", 5)
    known = ta.Stretches(a, b)
    assert [r[:5] for t in some + some for r in ta.aligned(known, [t])] == fresh + fresh
    assert len(known) <= 5 + 30 and all(len(s) <= ta.LONGEST for s in known)
