"""Words that differ by one letter, found by blocked Gram matrices.

A word is its vector of letter counts.  One inserted, deleted or replaced
letter moves that vector by a squared distance of at most two, so the product
of two blocks of vectors names every pair worth a look; the letters decide.
Blocks hold words of one length and of equal counts over a few groups of
letters.  An edit changes those counts by one up, one down, or both: a block
meets only the blocks so next to it, of its own length and the next.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.texts import batches_of
from tablewright.storage import cut_lineage, discard

#: Letters are A-Z, a-z and U+00C0 to U+00FF: one byte each in Latin-1.
RUN = "[A-Za-zÀ-ÿ]"
#: The column of a letter's count: a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64
COLUMN = np.array([c - 0xC0 + 26 if c >= 0xC0 else max(c - ord("a"), 0) for c in range(256)])
LEAST_LETTERS, LEAST_COUNT, FORM_TIMES = 7, 2, 10
#: One run in DAMAGED loses a letter, by a hash of document and run.
DAMAGED = 31
#: Groups of letters whose counts name a block, and the order in which a-z are dealt to them (frequent letters first).
GROUPS, DEALT = 6, "etaoinsrhldcumfpgwybvkxjqz"
#: Words, and letters, that one part of a block holds about; the letters compared at once; the words a task counts before it writes them.
PART_WORDS, PART_LETTERS, COMPARED, COUNTED = 512, 1 << 16, 1 << 22, 200_000


def damaged(name: bytes, run: bytes) -> bytes:
    """The lower-cased Latin-1 run, without one of its letters if the hash says so."""
    plain = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(plain, zlib.crc32(name + b":"))
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_letters: int, least_count: int) -> DataFrame:
    """(word, n) of the words that occur often enough, counted over all documents."""
    # A shorter run gives no word of that many letters; a longer one is matched whole.
    runs = re.compile(RUN + "{%d,}" % max(least_letters, 1))

    def count(batches):
        totals: Counter = Counter()

        def rows():
            for batch in batches:
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    own = Counter([r.encode("latin-1").lower() for r in runs.findall(text)])
                    for run, n in own.items():
                        word = damaged(name.encode(), run)
                        if len(word) >= least_letters:
                            totals[word] += n
                    if len(totals) >= COUNTED:
                        yield from ((w.decode("latin-1"), n) for w, n in totals.items())
                        totals.clear()
            yield from ((w.decode("latin-1"), n) for w, n in totals.items())

        yield from batches_of(rows(), pa.schema([("word", pa.string()), ("n", pa.int64())]))

    source = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return source.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letter_groups() -> list[str]:
    """Which letters go into which group: a-z to and fro in the order DEALT, the others by code point."""
    groups = [""] * GROUPS
    for rank, letter in enumerate(DEALT):
        at = rank % (2 * GROUPS)
        groups[min(at, 2 * GROUPS - 1 - at)] += letter
    for code in range(0xC0, 0x100):
        groups[code % GROUPS] += chr(code)
    return groups


def block_of(word: Column) -> Column:
    """How many letters of each group a word has; they add up to its length."""
    return F.array(*[F.length(word) - F.length(F.translate(word, g, "")) for g in letter_groups()])


def neighbours(block: Column) -> Column:
    """Of all blocks that may hold near words of `block`, itself and one of each two directions."""

    def moved(up: int, down: int | None) -> Column:
        return F.array(*[block[k] + (1 if k == up else -1 if k == down else 0) for k in range(GROUPS)])

    inserted = [moved(i, None) for i in range(GROUPS)]
    replaced = [moved(i, j) for i in range(GROUPS) for j in range(i + 1, GROUPS)]
    return F.array(block, *inserted, *replaced)


@dataclass
class Part:
    """Words of one length: their letters from the left and from the right, and vectors whose products give distances."""

    letters: np.ndarray
    mirrored: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Part:
        raw = [w.encode("latin-1") for w in words]
        letters = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
        cells = (np.arange(len(raw))[:, None] * LETTERS + COLUMN[letters]).ravel()
        counts = np.bincount(cells, minlength=len(raw) * LETTERS).reshape(len(raw), LETTERS).astype(np.float32)
        half, one = (counts * counts).sum(1, keepdims=True) / 2, np.ones((len(raw), 1), np.float32)
        # left . right of two words is minus half their squared distance.
        return cls(letters, np.ascontiguousarray(letters[:, ::-1]), np.hstack([counts, -half, one]), np.hstack([counts, one, -half]))


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters each row of a and of b begin with alike; a is at most as long as b."""
    same = np.ones((len(a), a.shape[1] + 1), bool)
    np.equal(a, b[:, : a.shape[1]], out=same[:, :-1])
    same[:, -1] = False
    return (~same).argmax(1)


def near_pairs(x: Part, y: Part, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of x and j of y whose words are one edit apart; x has as many letters as y or one less."""
    i, j = np.nonzero(x.left @ y.right.T >= -1)
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    step = max(1, COMPARED // y.letters.shape[1])
    for at in range(0, len(i), step):
        a, b = i[at : at + step], j[at : at + step]
        alike = agreeing(x.letters[a], y.letters[b]) + agreeing(x.mirrored[a], y.mirrored[b])
        keep[at : at + step] = alike >= y.letters.shape[1] - 1
    return i[keep], j[keep]


def found_in(words_x: list, n_x: np.ndarray, words_y: list, n_y: np.ndarray, i: np.ndarray, j: np.ndarray, times: int):
    """(word, near, form, form_n) for the words of x that are near words of y, which stand in code-point order."""
    n_near = np.bincount(i, minlength=len(words_x))
    form = np.full(len(words_x), -1)
    better = n_y[j] >= times * n_x[i]
    a, b = i[better], j[better]
    order = np.lexsort((b, -n_y[b], a))
    first, at = np.unique(a[order], return_index=True)
    form[first] = b[order][at]
    for k in np.flatnonzero(n_near).tolist():
        f = form[k]
        yield words_x[k], int(n_near[k]), words_y[f] if f >= 0 else None, int(n_y[f]) if f >= 0 else None


def near_words(words: DataFrame, times: int) -> DataFrame:
    """(word, near, form, form_n): for each word and meeting of two parts the near words met, and the best form among them."""
    placed = words.select("word", "n", block_of(F.col("word")).alias("block"))
    size = F.aggregate("block", F.lit(0), lambda a, k: a + k)
    share = F.ceil(F.col("words") * F.greatest(F.lit(1.0 / PART_WORDS), size / F.lit(float(PART_LETTERS)))).cast("int")
    blocks = cut_lineage(placed.groupBy("block").agg(F.count(F.lit(1)).alias("words")).select("block", F.greatest(share, F.lit(1)).alias("parts")), "blocks")
    dealt = placed.join(blocks, "block").select("word", "n", "block", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"))
    # About PART_WORDS of them, in code-point order.
    parts = dealt.groupBy("block", "part").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("rows"))
    parts = cut_lineage(parts.select("block", "part", F.col("rows.word").alias("words"), F.col("rows.n").alias("ns")), "parts")
    other = blocks.select(F.col("block").alias("other"), F.col("parts").alias("other_parts"))
    meetings = blocks.select("block", "parts", F.explode(neighbours(F.col("block"))).alias("other")).join(other, "other")
    meetings = meetings.select("block", "other", "other_parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    meetings = meetings.select("block", "other", "part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)).alias("other_part"))
    meetings = meetings.where((F.col("block") != F.col("other")) | (F.col("part") <= F.col("other_part")))
    theirs = parts.select(F.col("block").alias("other"), F.col("part").alias("other_part"), F.col("words").alias("other_words"), F.col("ns").alias("other_ns"))
    rows = meetings.join(parts, ["block", "part"]).join(theirs, ["other", "other_part"])
    rows = rows.select("words", "ns", "other_words", "other_ns", ((F.col("block") == F.col("other")) & (F.col("part") == F.col("other_part"))).alias("same"))

    def meet(batches):
        def found():
            last: tuple[list, Part | None] = ([], None)
            for batch in batches:
                for words_x, n_x, words_y, n_y, same in zip(*[c.to_pylist() for c in batch.columns]):
                    if words_y != last[0]:
                        last = (words_y, Part.of(words_y))
                    x, y = last[1] if same else Part.of(words_x), last[1]
                    i, j = near_pairs(x, y, same)
                    if not len(i):
                        continue
                    n_x, n_y = np.array(n_x, np.int64), np.array(n_y, np.int64)
                    yield from found_in(words_x, n_x, words_y, n_y, i, j, times)
                    yield from found_in(words_y, n_y, words_x, n_x, j, i, times)

        yield from batches_of(found(), pa.schema([("word", pa.string()), ("near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())]))

    return rows.mapInArrow(meet, "word string, near bigint, form string, form_n bigint")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last word that forms lead to, each round twice as far as the one before.

    A form is FORM_TIMES as frequent as its word, so there is no way round and few rounds.
    """
    links = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = links.join(onward, links["root"] == onward["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = cut_lineage(moved, "roots")
        discard(links)
        links = moved
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = FORM_TIMES,
) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words are runs of letters, A-Z lowered, of at least `least_letters`, that
    occur `least_count` times over all texts; one run in DAMAGED loses a letter
    first.  Near words differ by one inserted, deleted or replaced letter.  The
    form is the most frequent near word (ties: the smallest by code points)
    if it is at least `times` as frequent, else null; the root is the last
    form.  Null and empty texts have no words, a null id counts as empty text,
    repeated rows count as often as they stand.  No words: an empty result;
    further columns are ignored.
    """
    words = cut_lineage(word_counts(docs, id_col, text_col, least_letters, least_count), "words")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("minus"), "form")))
    near = near_words(words, times).groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    near = cut_lineage(near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n")), "near-words")
    roots = rooted(near.where("form is not null").select("word", "form"))
    found = words.join(near, "word", "left").join(roots, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
