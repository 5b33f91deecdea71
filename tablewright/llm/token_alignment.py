"""Alignment of two tokenizers over a corpus, each distinct text tokenised once.

The table is shuffled by the whole text, so equal texts meet and are counted.
A distinct text is encoded by both tokenizers; the byte offsets at which both
end a token cut it into groups, and tokens whose bytes overlap are linked.
Links are counted over the corpus with the text's multiplicity, the counts go
back to the texts, and the texts' measures go to the ids by the text's hash.

Neither tokenizer joins a space to what stands before it, so a text falls into
stretches, each a space and what follows up to the next space that comes after
no white space.  Stretches are encoded and aligned by themselves, and a task
remembers those it has met.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.texts import id_and_text
from tablewright.storage import cut_lineage

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Id pairs of a counted table that is sent to every task (16 bytes each); a larger one is joined by a shuffle.
SENT_PAIRS = 2_000_000
#: Texts aligned at once, and their characters; stretches a task remembers, and the characters of the longest of them.
BATCH_TEXTS, BATCH_CHARS, REMEMBERED, LONGEST = 256, 1 << 20, 100_000, 64
#: Before such a space neither tokenizer's tokens go on.
BOUNDARY = re.compile(r"(?<=\S)(?= )")
#: A text of more than one row in HOT_SHARE is dealt over SALTS tasks when measures go back to ids.
HOT_SHARE, SALTS = 1000, 64


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Side:
    """One tokenizer: ids of a text that begins with a space, and the bytes of every id."""

    def __init__(self, pieces: list[bytes | None]):
        self.pieces = [p if p is not None else b"" for p in pieces]
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.names = [str(i) for i in range(len(self.pieces))]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class ByteSide(Side):
    """A byte-level vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        alphabet, size = byte_alphabet(), self.encoder.get_vocab_size(True)
        entries = [self.encoder.id_to_token(i) for i in range(size)]
        super().__init__([bytes(map(alphabet.__getitem__, e)) if e is not None and all(c in alphabet for c in e) else None for e in entries])

    def encode(self, text: str) -> list[int]:
        return self.encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids


class PieceSide(Side):
    """A piece vocabulary with byte fallback; it adds a space to what it is given, so a letter goes ahead."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.encoder = SentencePieceProcessor(model_file=path)
        n = self.encoder.get_piece_size()
        pieces = [self.encoder.id_to_piece(i) for i in range(n)]
        special = [self.encoder.is_control(i) or self.encoder.is_unknown(i) for i in range(n)]
        if any(re.search("[^▁]▁", p) for i, p in enumerate(pieces) if not special[i]):
            raise ValueError("a piece that goes on over a space: texts do not fall into stretches")
        super().__init__(
            [None if special[i] else bytes([int(p[3:5], 16)]) if self.encoder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        )
        self.ahead = len(self.encoder.encode("a"))

    def encode(self, text: str) -> list[int]:
        return self.encoder.encode("a" + text)[self.ahead :]


@lru_cache(maxsize=2)
def side(kind: str, path: str) -> Side:
    """A tokenizer of this process, loaded once."""
    return {"byte": ByteSide, "piece": PieceSide}[kind](path)


MEASURES = ["sha", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]
NO_TOKENS = (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))


Alignment = tuple[int, int, int, str, list[int]]


def align(a: Side, b: Side, stretches: list[str]) -> list[Alignment] | None:
    """(n_a, n_b, n_groups, groups, linked id pairs in order) of each stretch, all encoded in one go.

    None if a tokenizer does not give the bytes back, or has a token across
    two stretches.
    """
    text = "".join(stretches)
    ids_a, ids_b, whole = a.encode(text), b.encode(text), text.encode()
    if a.joined(ids_a) != whole or b.joined(ids_b) != whole:
        return None
    row_a, row_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    ends_a, ends_b = a.sizes[row_a].cumsum(), b.sizes[row_b].cumsum()
    # Between two neighbouring ends of either side lies one piece of one token each: a link.
    ends, shared = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
    links = (row_a[np.searchsorted(ends_a, ends)] * len(b.pieces) + row_b[np.searchsorted(ends_b, ends)]).tolist()
    cuts = np.cumsum([len(s.encode()) for s in stretches])
    if not np.isin(cuts, shared, assume_unique=True).all():
        return None
    to_a, to_b = (np.searchsorted(ends_a, shared) + 1).tolist(), (np.searchsorted(ends_b, shared) + 1).tolist()
    names_a, names_b = list(map(a.names.__getitem__, ids_a)), list(map(b.names.__getitem__, ids_b))
    groups, from_a, from_b = [], 0, 0
    for i, j in zip(to_a, to_b):
        # Most groups are a token of each.
        first = names_a[from_a] if i == from_a + 1 else ",".join(names_a[from_a:i])
        groups.append(f"{first}|{names_b[from_b] if j == from_b + 1 else ','.join(names_b[from_b:j])}")
        from_a, from_b = i, j
    found, at = [], (0, 0, 0, 0)
    for g, k in zip((np.searchsorted(shared, cuts) + 1).tolist(), (np.searchsorted(ends, cuts) + 1).tolist()):
        now = (to_a[g - 1], to_b[g - 1], g, k)
        found.append((now[0] - at[0], now[1] - at[1], g - at[2], ";".join(groups[at[2] : g]), links[at[3] : k]))
        at = now
    return found


class Stretches(dict):
    """stretch -> its alignment, None where a tokenizer does not give it back."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.before: dict[str, Alignment | None] = {}
        self.long: list[str] = []

    def learn(self, stretches: list[str]) -> None:
        self.update((s, self.before[s]) for s in stretches if s in self.before)
        stretches = [s for s in stretches if s not in self.before]
        self.long += [s for s in stretches if len(s) > LONGEST]
        # White space at the end would run on into the next one.
        plain = [s for s in stretches if not s[-1].isspace()]
        found = align(self.a, self.b, plain) if plain else []
        if found is not None:
            self.update(zip(plain, found))
        for text in stretches:
            if text not in self:
                self[text] = (align(self.a, self.b, [text]) or [None])[0]

    def forget(self) -> None:
        """Keep memory bounded: long stretches go at once, others when REMEMBERED more have come without them."""
        for long in [s for s in self.long if s in self]:
            del self[long]
        self.long.clear()
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()


def aligned(known: Stretches, texts: list[str]):
    """A row of MEASURES[2:] for each text; an empty text, or one that a tokenizer does not give back whole, has no tokens."""
    cut = [BOUNDARY.split(" " + text) if text else [] for text in texts]
    new = [s for s in dict.fromkeys(chain.from_iterable(cut)) if s not in known]
    known.learn(new)
    for stretches in cut:
        parts = [known[s] for s in stretches]
        if not parts or None in parts:
            yield NO_TOKENS
            continue
        n_a, n_b, n_groups, groups, links = zip(*parts)
        pairs, counts = np.unique(np.fromiter(chain.from_iterable(links), np.int64), return_counts=True)
        yield sum(n_a), sum(n_b), sum(n_groups), int(counts.sum()), hashlib.sha256(";".join(groups).encode()).hexdigest(), pairs, counts
    known.forget()


def runs_of(texts: list[str]):
    """Runs of texts that are small enough to be aligned at once; a long text is a run of its own."""
    run, chars = [], 0
    for text in texts:
        if run and (len(run) == BATCH_TEXTS or chars + len(text) > BATCH_CHARS):
            yield run
            run, chars = [], 0
        run.append(text)
        chars += len(text)
    if run:
        yield run


def measured_texts(texts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(sha, copies, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links) per row (text, copies).

    `pairs` are id of A times the size of B's vocabulary, plus id of B.
    """

    def measure(batches):
        known = Stretches(side("byte", byte_path), side("piece", piece_path))
        for batch in batches:
            at = 0
            for run in runs_of(batch.column(0).to_pylist()):
                rows, part = list(aligned(known, run)), batch.slice(at, len(run))
                at += len(run)
                ends = pa.array(np.append(0, np.cumsum([len(r[5]) for r in rows])), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[k] for r in rows]))) for k in (5, 6)]
                plain = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *plain, pa.array([r[4] for r in rows], pa.string()), *lists], names=MEASURES)

    source = texts.select("text", F.unhex(F.sha2("text", 256)).alias("sha"), "copies")
    kinds = ["binary", *["bigint"] * 5, "string", "array<bigint>", "array<bigint>"]
    return source.mapInArrow(measure, ", ".join(f"{n} {k}" for n, k in zip(MEASURES, kinds)))


def pair_counts(measured: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): the corpus-wide links of every id pair, and whether no pair of its id of B has more."""
    rows = measured.select("copies", F.explode(F.arrays_zip("pairs", "links")).alias("p"))
    counts = cut_lineage(rows.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum(F.col("copies") * F.col("p.links")).alias("count")), "pair-counts")
    of_b = F.pmod("pair", F.lit(size_b))
    top = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("top"))  # an id of B has at most as many pairs as A has ids
    return cut_lineage(counts.withColumn("b", of_b).join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "pairs")


def token_alignment(docs: DataFrame, byte_path: str = f"{TOKENIZERS}/{BYTE_BPE}", piece_path: str = f"{TOKENIZERS}/{PIECE_BPE}", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: per row id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and per linked id pair a, b, count, best.

    A is the byte-level vocabulary, given a space and the text; B the piece
    vocabulary, which adds that space.  Strings of special tokens in a text
    are plain text.  Null or empty texts, and texts that the tokens of A or B
    do not give back byte for byte, have no tokens: all measures 0, the digest
    ''.  `n_best` are links whose pair is its B id's most frequent (ties
    count), `count_sum` adds the corpus-wide counts of all links.  Repeated
    rows and ids count as often as they stand, null ids too.  An empty table
    gives two empty ones; further columns are ignored.  Both paths must be
    readable on every executor.
    """
    spark = docs.sparkSession
    size_b = len(side("piece", piece_path).pieces)
    base = id_and_text(docs, id_col, text_col)
    distinct = base.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    measured = cut_lineage(measured_texts(distinct, byte_path, piece_path), "aligned-texts")
    pairs = pair_counts(measured, size_b)
    sent = F.broadcast(pairs) if pairs.count() <= SENT_PAIRS else pairs
    links = measured.select("sha", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("sha", F.col("p.pairs").alias("pair"), F.col("p.links").alias("n"))
    sums = (
        links.join(sent, "pair")
        .groupBy("sha")
        .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    )
    # Texts of many copies, fewer than HOT_SHARE of them, are dealt over SALTS tasks; so are empty ones, which have no measures.
    rows = base.count()
    is_hot = F.col("copies") * HOT_SHARE > rows
    hot = measured.where(is_hot).select("sha", F.lit(True).alias("hot"))
    named = base.select("id", F.unhex(F.sha2("text", 256)).alias("sha"), (F.col("text") == "").alias("empty"), F.monotonically_increasing_id().alias("at"))
    dealt = named.join(F.broadcast(hot), "sha", "left").select(
        "id", "sha", F.when(F.col("hot") | F.col("empty"), F.pmod("at", F.lit(SALTS))).otherwise(0).cast("int").alias("salt")
    )
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    own = measured.join(sums, "sha", "left").select("sha", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", F.explode(salts).alias("salt"))
    found = dealt.join(own, ["sha", "salt"], "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    measures = found.select(F.col("id").alias(id_col), *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    table = pairs.select(F.floor(F.col("pair") / size_b).alias("a"), F.pmod("pair", F.lit(size_b)).alias("b"), "count", "best")
    return measures, table
