"""Toxicity: subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, so an unseen
spelling shares most of them.  The vectors of a segment of words are averaged
and go into the softmax; a document is as toxic as its most toxic segment, so
a long text does not water down a few words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.functions import ArrowUDFType

from tablewright.llm.texts import CACHE_WORDS, MIX, fold_of, id_and_bytes, mixed

BUCKETS, WIDTH = 1 << 17, 8
GRAMS = (3, 4, 5)
SEGMENT_WORDS = 12
#: Bounds of the labelled sample that is fitted on the driver: rows, and bytes of one text in it.
MAX_ROWS, MAX_TEXT_BYTES = 8192, 4096
#: Steps over the whole sample, the step, what stays of the last one, the pull towards 0, and how far the first vectors lie from 0.
EPOCHS, RATE, MOMENTUM, DECAY, START, SEED = 60, 0.1, 0.9, 0.02, 0.01, 7
EDGES = "!\"#$%&'()*+,-./:;<=>?[\\]^_`{|}~"
#: Characters of texts scored at once, and of words hashed at once.
TEXT_CHARS, WORD_CHARS = 1 << 20, 1 << 18


@dataclass
class Subwords:
    """The n-grams of words: a row of buckets for each character, of which BUCKETS stands for none."""

    buckets: np.ndarray  # (characters, len(GRAMS) + 1)
    starts: np.ndarray  # the first character of each word
    sizes: np.ndarray  # how many n-grams each word has

    @classmethod
    def of(cls, words: list[bytes]) -> Subwords:
        """Of every word in lower case, punctuation at its edges left off: its n-grams and itself."""
        plain = [w.decode("utf-8", "replace").lower() for w in words]
        marked = [f"<{w.strip(EDGES) or w}>" for w in plain]
        codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.array([len(w) for w in marked], np.int64)
        starts = np.append(0, lengths.cumsum()[:-1]) if len(marked) else np.empty(0, np.int64)
        left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))  # characters up to the word's end
        buckets = np.full((len(codes), len(GRAMS) + 1), BUCKETS, np.int32)
        for column, n in enumerate(GRAMS):
            at = np.flatnonzero(left >= n)
            total = np.full(len(at), n, np.uint64)
            for i in range(n):
                total = total * MIX + codes[at + i]
            buckets[at, column] = (mixed(total) % np.uint64(BUCKETS)).astype(np.int32)
        if len(marked):
            place = (np.arange(len(codes)) - np.repeat(starts, lengths)).astype(np.uint64)
            whole = np.add.reduceat(mixed(codes * MIX + place), starts)
            buckets[starts, -1] = (mixed(whole) % np.uint64(BUCKETS)).astype(np.int32)
        sizes = 1 + sum((np.maximum(lengths - n + 1, 0) for n in GRAMS), np.zeros(len(lengths), np.int64))
        return cls(buckets, starts, sizes)

    def means(self, margins: np.ndarray) -> np.ndarray:
        """The mean margin of each word's n-grams."""
        if not len(self.starts):
            return np.empty(0)
        known, each = np.append(margins, 0).astype(np.float32), np.empty(len(self.buckets), np.float32)
        for at in range(0, len(each), WORD_CHARS):
            each[at : at + WORD_CHARS] = known[self.buckets[at : at + WORD_CHARS]].sum(1)
        return np.add.reduceat(each, self.starts).astype(np.float64) / self.sizes

    def spread(self, of_word: np.ndarray) -> np.ndarray:
        """What each bucket gets when a word hands a number to all its n-grams alike."""
        lengths = np.diff(np.append(self.starts, len(self.buckets)))
        each, total = np.repeat(of_word / self.sizes, lengths), np.zeros(BUCKETS + 1)
        for at in range(0, len(each), WORD_CHARS):
            part = self.buckets[at : at + WORD_CHARS]
            total += np.bincount(part.ravel(), np.repeat(each[at : at + WORD_CHARS], part.shape[1]), BUCKETS + 1)
        return total[:-1]


@dataclass
class Model:
    vectors: np.ndarray  # (BUCKETS, WIDTH)
    weights: np.ndarray  # (2, WIDTH)
    bias: np.ndarray  # (2,)

    def margins(self) -> np.ndarray:
        """What a bucket adds to the logit of label 1 over label 0."""
        return self.vectors @ (self.weights[1] - self.weights[0])


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> Model:
    """Gradient descent on vectors, softmax and bias together, from a small random start.

    The vectors of a segment's words are averaged and go into the softmax.
    Which segment of a toxic document is toxic is not labelled: the softmax
    over its segments' logits shares out the document's gradient.  A step is
    scaled by the root mean square of its whole gradient, not entry by entry,
    so a rare n-gram never learns as fast as a common one.
    """
    rng = np.random.default_rng(SEED)
    model = Model(rng.normal(0, START, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, 1, (2, WIDTH)).astype(np.float32), np.zeros(2))
    if not texts:
        model.vectors[:] = 0
        return model
    types: dict[bytes, int] = {}
    ids = [np.fromiter((types.setdefault(w, len(types)) for w in text.split()), np.int32) for text in texts]
    length, doc_of = [], []
    for doc, part in enumerate(ids):
        cuts = range(0, max(len(part), 1), SEGMENT_WORDS)
        length += [min(SEGMENT_WORDS, len(part) - at) for at in cuts]
        doc_of += [doc] * len(cuts)
    length, doc_of, token = np.array(length), np.array(doc_of, np.int32), np.concatenate(ids)
    words, n_types = Subwords.of(list(types)), len(types)
    del types, ids, texts
    seg_of = np.repeat(np.arange(len(length), dtype=np.int32), length)
    size = np.maximum(length, 1)
    y = np.array(labels, np.float64)
    starts = np.flatnonzero(np.append(True, doc_of[1:] != doc_of[:-1]))
    prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    model.bias[:] = -prior / 2, prior / 2
    moves = [np.zeros_like(model.vectors), np.zeros_like(model.weights)]
    for epoch in range(epochs):
        gap = model.weights[1] - model.weights[0]
        of_segment = np.bincount(seg_of, words.means(model.vectors @ gap)[token], len(length)) / size
        top = np.maximum.reduceat(of_segment, starts)
        share = np.exp(of_segment - top[doc_of])
        share /= np.bincount(doc_of, share)[doc_of]
        error = 1 / (1 + np.exp(-np.clip(top + model.bias[1] - model.bias[0], -30, 30))) - y
        to_word = np.bincount(token, (error[doc_of] * share / size)[seg_of], n_types)
        to_bucket = words.spread(to_word).astype(np.float32)
        pull = to_bucket @ model.vectors
        grads = [to_bucket[:, None] * gap, np.stack([-pull, pull])]
        step = RATE * (1 - epoch / epochs)
        for p, g, m in zip([model.vectors, model.weights], grads, moves):
            norm = float(np.sqrt((g[g != 0] ** 2).mean())) if (g != 0).any() else 1.0
            m *= MOMENTUM
            m += (1 - MOMENTUM) * g / norm
            p -= (step * m + step * DECAY * p).astype(p.dtype)
        scale, bias = calibrated(top, y)
        model.bias[:] = -bias / 2, bias / 2
        model.weights *= np.clip(scale, 0.5, 2)
    gap = model.weights[1] - model.weights[0]
    top = np.maximum.reduceat(np.bincount(seg_of, words.means(model.vectors @ gap)[token], len(length)) / size, starts)
    scale, bias = calibrated(top, y)
    model.weights *= scale
    model.bias[:] = -bias / 2, bias / 2
    return model


def calibrated(top: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The scale and bias of the logits with the least log loss, by damped Newton steps on two numbers."""
    spread = float(top.std()) or 1.0
    x = np.stack([(top - top.mean()) / spread, np.ones_like(top)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, x.T @ (p - y) + 1e-1 * w), -1, 1)
    scale = max(float(w[0]), 1e-3) / spread
    return scale, float(w[1] - scale * top.mean())


class WordMargins(dict):
    """word -> its logit, learnt for the words of some texts at a time."""

    def __init__(self, margins: np.ndarray):
        self.margins = margins

    def learn(self, words: set[bytes]) -> None:
        if len(self) + len(words) > CACHE_WORDS // 4:
            self.clear()
        run, chars = [], 0
        for word in words:
            if word in self:
                continue
            run.append(word)
            chars += len(word)
            if chars > WORD_CHARS:
                self.update(zip(run, Subwords.of(run).means(self.margins).tolist()))
                run, chars = [], 0
        self.update(zip(run, Subwords.of(run).means(self.margins).tolist()))


def score_text(words: list[bytes], margins: dict[bytes, float], bias: float) -> float:
    values = np.fromiter(map(margins.__getitem__, words), np.float64, len(words))
    top = 0.0
    if len(values):
        starts = np.arange(0, len(values), SEGMENT_WORDS)
        top = float((np.add.reduceat(values, starts) / np.diff(np.append(starts, len(values)))).max())
    return float(1 / (1 + np.exp(-np.clip(top + bias, -30, 30))))


def scores(texts: list[bytes], margins: WordMargins, bias: float):
    """The score of each text, a bounded number of characters at a time."""
    run, chars = [], 0
    for at, text in enumerate(texts):
        run.append(text.split())
        chars += len(text)
        if chars > TEXT_CHARS or at == len(texts) - 1:
            margins.learn(set().union(*run))
            yield from (score_text(words, margins, bias) for words in run)
            run, chars = [], 0


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, max_rows: int, max_text_bytes: int) -> tuple[list[bytes], list[int]]:
    """A bounded sample of labelled rows outside fold 0, in the order of a hash of the id."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label is not null")
    chosen = (
        known.where(fold_of(F.col("id"), folds) != 0).groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    )
    # At most max_rows ids and labels: small enough to be sent to every task.
    texts = id_and_bytes(docs, id_col, text_col).where(F.octet_length("text") <= max_text_bytes)
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("text").alias("text"), F.max("label").alias("label")).toArrow()
    rows = rows.take(pa.compute.sort_indices(rows["id"])) if rows.num_rows else rows
    return rows["text"].to_pylist(), rows["label"].to_pylist()


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, max_rows: int, max_text_bytes: int):
    """The trained scorer: a function of a text column."""
    texts, marks = sample(docs, labels, id_col, text_col, label_col, folds, max_rows, max_text_bytes)
    model = train(texts, marks)
    # One number per bucket goes to the tasks, whatever the corpus holds.
    sent = docs.sparkSession.sparkContext.broadcast((model.margins().astype(np.float32), float(model.bias[1] - model.bias[0])))

    def score(parts):
        margins, bias = sent.value
        words = WordMargins(margins)
        for part in parts:
            yield pa.array(list(scores(part.to_pylist(), words, bias)), pa.float64())

    scorer = F.arrow_udf(score, "double", functionType=ArrowUDFType.SCALAR_ITER)
    return lambda text: scorer(F.coalesce(text, F.lit("")).cast("binary"))


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    folds: int = 5, max_rows: int = MAX_ROWS, max_text_bytes: int = MAX_TEXT_BYTES,
) -> DataFrame:
    """Per row: id, held_out, score in 0..1, predicted (score >= 0.5).

    Learns from at most `max_rows` labelled documents with texts of at most
    `max_text_bytes` and an id outside fold 0; scores every whole text.  Null
    or empty text gets the score of the bias alone.  Null labels and labels
    of unknown documents are not used; an id labelled twice takes the larger
    label.  Without any label all scores are the untrained 0.5.
    """
    score = fitted(docs, labels, id_col, text_col, label_col, folds, max_rows, max_text_bytes)
    scored = docs.select(docs[id_col].alias("id"), score(docs[text_col]).alias("score"))
    return scored.select(
        F.col("id").alias(id_col), (fold_of(F.col("id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, max_rows: int = MAX_ROWS, max_text_bytes: int = MAX_TEXT_BYTES) -> DataFrame:
    """The rows of docs that `toxicity` would not reject, with all their columns; nothing is shuffled."""
    return docs.where(fitted(docs, labels, id_col, text_col, label_col, folds, max_rows, max_text_bytes)(docs[text_col]) < 0.5)
