"""Brown class-based n-grams: P(w | v) = P(class of w | class of v) P(w | class of w).

Every training word gets its class by exchange clustering of the corpus' bigram
counts: the most frequent on the driver, one by one, all others side by side
against the classes of the round before, each from its own neighbours.
Frequent words with counts and classes go to every task; the long tail is
joined with its counts and classes by Spark.  A word never seen takes the class
that holds most training words of its last letters.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.texts import fold_of, id_and_bytes, id_type
from tablewright.storage import cut_lineage, discard

#: Words whose counts go to every task, the most bytes of one, how many of them start the clustering on the driver, and the classes of all words.
HEAD_WORDS, HEAD_BYTES, CLUSTERED, CLASSES = 1 << 18, 64, 512, 64
#: Where words stand until their first exchange, by their last two bytes.
SUFFIX_CLASSES = 16
ROUNDS, ADDED, PRIOR = 6, 0.3, 50.0
#: Bytes of texts split in one go, and tokens whose neighbours are counted in one go.
TEXT_BYTES, TOKENS_AT_ONCE = 1 << 22, 1 << 21
#: Neighbours of words whose gains a task computes in one go, and counts up to which it looks gains up.
ROWS_AT_ONCE, SMALL = 4_000, 16
#: Pairs of neighbours in a block, and parts into which the frequent words are dealt.
BLOCK, SLICES = 1 << 18, 64


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SUFFIX_CLASSES


@cache
def suffix_table() -> np.ndarray:
    """The suffix class of every two bytes, then of every single one."""
    words = [bytes([a, b]) for a in range(256) for b in range(256)] + [bytes([a]) for a in range(256)]
    return np.array([suffix_class(w) for w in words])


def suffix_classes(words: pa.Array) -> np.ndarray:
    """`suffix_class` of many words, none of them empty."""
    if not len(words):
        return np.empty(0, np.int64)
    offsets, data = (np.frombuffer(buffer, kind) for buffer, kind in zip(words.buffers()[1:], (np.int32, np.uint8)))
    ends, sizes = offsets[words.offset + 1 :][: len(words)], np.diff(offsets[words.offset :][: len(words) + 1])
    last = data[ends - 1].astype(np.int64)
    return suffix_table()[np.where(sizes > 1, data[ends - 2] * np.int64(256) + last, (1 << 16) + last)]


def texts_at_once(batches, text_at: int = 0):
    """The batches, cut where their texts come to TEXT_BYTES."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text_at)).to_numpy(), dtype=np.int64)
        first = 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
            yield batch.slice(first, last - first)
            first = last


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-case words of all texts, as bytes, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, offsets = parts.flatten().cast(pa.binary()), parts.offsets.to_numpy()
    full = pc.binary_length(words).to_numpy() > 0  # white space at either end leaves an empty part
    ends = np.append(0, np.cumsum(full))
    return words if full.all() else words.filter(pa.array(full)), np.diff(ends[offsets])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, suffix, c) over all texts, counted within tasks before the shuffle; `word` is lower-case bytes."""

    def count(batches):
        for piece in texts_at_once(batches):
            found = split_words(piece.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "c"])

    counted = texts.select("text").mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    return counted.select("word", (F.crc32(F.substring("word", -2, 2)) % SUFFIX_CLASSES).cast("int").alias("suffix"), "c")


def word_ids(words: pa.Array, head: pa.Array) -> np.ndarray:
    """The place of each word among the frequent ones, else their number + its suffix class."""
    ids = pc.index_in(words, value_set=head).fill_null(-1).to_numpy().astype(np.int64)
    rare = np.flatnonzero(ids < 0)
    ids[rare] = len(head) + suffix_classes(words.take(pa.array(rare)))
    return ids


def in_a_row(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with the `end` before, between and behind them, and the place of each word."""
    places = np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts) + 1
    seq = np.full(len(ids) + len(counts) + 1, end)
    seq[places] = ids
    return seq, places


def next_words(words: pa.Array, at: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """The word behind each of those `at`, null where it is not `wanted`."""
    return words.take(pa.array(at + 1, mask=~wanted))


def counted_rows(columns: dict) -> pa.Table:
    """The distinct rows of some columns, with how often they stand as `count_all`."""
    return pa.table(columns).group_by(list(columns), use_threads=False).aggregate([([], "count_all")]).combine_chunks()


def neighbours(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """Who stands beside whom, counted within tasks: rows (word, next, a, b, n, block).

    A block holds many (a, b, n), ids of `word_ids` or the end, b after a.  Words
    that are not frequent have rows of their own as well: `word` between a and
    b, with the `next` word where that is not frequent either.
    """
    sent = texts.sparkSession.sparkContext.broadcast(pa.array(words, pa.binary()))
    names = ["word", "next", "a", "b", "n", "block"]
    types = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def count(batches):
        head = sent.value
        size = len(head) + SUFFIX_CLASSES + 1
        waiting, n = [], 0

        def flushed():
            codes, times = np.unique(np.concatenate(waiting), return_counts=True)
            packs = [pack(codes[i : i + BLOCK] // size, codes[i : i + BLOCK] % size, times[i : i + BLOCK]) for i in range(0, len(codes), BLOCK)]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(packs), t) for t in types[:-1]), pa.array(packs, types[-1])], names=names)

        for piece in texts_at_once(batches):
            words, counts = split_words(piece.column(0))
            ids = word_ids(words, head)
            seq, places = in_a_row(ids, counts, size - 1)
            waiting.append(seq[:-1] * size + seq[1:])
            n += len(seq)
            rare = np.flatnonzero(ids >= len(head))
            if len(rare):
                before, after = (seq[places[rare] + step].astype(np.int32) for step in (-1, 1))
                following = next_words(words, rare, (after >= len(head)) & (after < size - 1))
                found = counted_rows({"word": words.take(pa.array(rare)), "next": following, "a": before, "b": after})
                yield from found.append_column("block", pa.nulls(len(found), types[-1])).rename_columns(names).to_batches()
            if n > TOKENS_AT_ONCE:
                yield flushed()
                waiting, n = [], 0
        if waiting:
            yield flushed()

    return texts.select("text").mapInArrow(count, "word binary, next binary, a int, b int, n bigint, block binary")


def bigram_counts(pairs: DataFrame, of: np.ndarray, states: int) -> np.ndarray:
    """Counts between the states `of` the ids; its size is fixed, so it may come to the driver."""
    sent = pairs.sparkSession.sparkContext.broadcast(of)

    def count(batches):
        total = np.zeros(states * states)
        for a, b, n in blocks(batches):
            total += np.bincount(sent.value[a] * states + sent.value[b], n, states * states)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells].astype(np.int64), pa.int64())], names=["cell", "n"])

    found = pairs.where("block IS NOT NULL").select("block").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(states * states, np.float64)
    matrix[found["cell"].to_numpy()] = found["n"].to_numpy()
    return matrix.reshape(states, states)


def folded(counts: np.ndarray, onto: np.ndarray, states: int) -> np.ndarray:
    """Counts between states that are summed into others, `onto` which each goes."""
    matrix = np.zeros((states, states))
    np.add.at(matrix, (onto[:, None], onto), counts)
    return matrix


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers below 2^31, of one length, as bytes."""
    return zlib.compress(np.stack(columns).astype(np.int32).tobytes(), 1)


def unpack(packed: bytes, columns: int = 3) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.int32).reshape(columns, -1).astype(np.int64)


def blocks(batches, rows: int = 1 << 20):
    """The columns of packed blocks, many blocks at a time."""
    waiting, n = [], 0
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            waiting.append(unpack(packed))
            n += waiting[-1].shape[1]
            if n > rows:
                yield np.concatenate(waiting, 1)
                waiting, n = [], 0
    if waiting:
        yield np.concatenate(waiting, 1)


def head_classes(pairs: DataFrame, of: np.ndarray, moving: np.ndarray, between: np.ndarray, classes: int) -> DataFrame:
    """(word, class) of the `moving` frequent words, ids, each in its best class.

    A word's neighbours are counted by state, those before it behind all those
    after it.  The words are dealt to SLICES; the counts of one slice have a
    fixed size.
    """
    sent = pairs.sparkSession.sparkContext.broadcast((of, moving, between))
    width = 2 * len(between)

    def count(batches):
        of, moving, _ = sent.value
        for a, b, n in blocks(batches):
            first, second = moving[a], moving[b]
            word, code = np.concatenate([a[first], b[second]]), np.concatenate([of[b[first]], len(between) + of[a[second]]])
            # Key and count sorted as one number.
            rows = -(-len(of) // SLICES)
            both = np.sort(((word % SLICES * rows + word // SLICES) * width + code) << 31 | np.concatenate([n[first], n[second]]))
            starts = np.flatnonzero(np.diff(both >> 31, prepend=-1))
            keys, n = both[starts] >> 31, np.add.reduceat(both & (1 << 31) - 1, starts)
            ends = np.searchsorted(keys, np.arange(1, SLICES + 1) * rows * width)
            places = keys % (rows * width)
            packed = [pack(places[i:j] // width, places[i:j] % width, n[i:j]) for i, j in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names=["slice", "block"])

    def move(batches):
        of, _, between = sent.value
        rows, now, total = -(-len(of) // SLICES), None, None

        def moved():
            word, code = np.nonzero(total)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            ids = word[starts] * SLICES + now
            best = runs_of_words(code, total[word, code], starts, of[ids], between, classes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(best, pa.int32())], names=["word", "class"])

        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now:
                    if now is not None:
                        yield from moved()
                    now, total = part, np.zeros((rows, width))
                word, code, n = unpack(packed)
                total[word, code] += n  # a block has a pair once
        if now is not None:
            yield from moved()

    counted = pairs.where("block IS NOT NULL").select("block").mapInArrow(count, "slice int, block binary")
    return counted.repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(move, "word int, class int")


def xlogx(values):
    return values * np.log(np.maximum(values, 1))


class Gains:
    """What xlogx of the numbers of a table gains in each of its columns as a count is added to them."""

    def __init__(self, table: np.ndarray):
        self.table = table
        # Most counts are small: these are looked up.
        self.small = np.stack([xlogx(table + n) - xlogx(table) for n in range(SMALL + 1)])

    def of(self, rows: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For every row and its n; column `own`, if there is such, holds the n already and gains it anew."""
        counts = n.astype(np.int64)
        found = self.small[np.minimum(counts, SMALL), rows]
        large = np.flatnonzero(counts > SMALL)
        base = self.table[rows[large]]
        found[large] = xlogx(base + n[large, None]) - xlogx(base)
        mine = np.flatnonzero(own < self.table.shape[1])
        column = own[mine]
        base = self.table[rows[mine], column]
        found[mine, column] = xlogx(base) - xlogx(base - n[mine])
        return found


def runs_of_words(codes: np.ndarray, n: np.ndarray, starts: np.ndarray, own: np.ndarray, between: np.ndarray, classes: int) -> np.ndarray:
    """The class that gains most likelihood for every word, its neighbours staying where they are.

    The neighbours of a word are a run of `codes` that begins at its `starts`;
    `own` is the class whose counts hold the word's own, or none of `classes`.
    Some words are done at a time.
    """
    states = len(between)
    cells = Gains(np.concatenate([between[:classes].T, between[:, :classes]]))
    sums = Gains(np.stack([between[:classes].sum(1), between[:, :classes].sum(0)]))
    ends, best, first = np.append(starts[1:], len(codes)), np.empty(len(starts), np.int64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + ROWS_AT_ONCE, "right")))
        rows, words = slice(starts[first], ends[last - 1]), slice(first, last)
        which = np.repeat(np.arange(last - first), ends[words] - starts[words])
        code, times = codes[rows], n[rows]
        gain = np.add.reduceat(cells.of(code, times, own[words][which]), starts[words] - starts[first], 0)
        for row, side in enumerate((code < states, code >= states)):
            of_word = np.bincount(which, times * side, last - first)
            gain -= sums.of(np.full(last - first, row), of_word, own[words])
        best[words] = gain.argmax(1)
        first = last
    return best


def tail_classes(pairs: DataFrame, of: np.ndarray, between: np.ndarray, classes: int) -> DataFrame:
    """(word, class, suffix, c) of every word that is not frequent, in its best class; `c` is its count."""
    sent = pairs.sparkSession.sparkContext.broadcast((of, between))
    states = len(between)

    def code(batches):
        of, _ = sent.value
        for batch in batches:
            before, after = (of[batch.column(i).to_numpy()] for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before * states + after, pa.int32()), batch.column(3)], names=["word", "code", "n"])

    def move(batches):
        _, between = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            words, lists = batch.column(0), batch.column(1)
            which = np.repeat(np.arange(len(words)), np.asarray(pc.list_value_length(lists)))
            flat = lists.flatten()
            beside, n = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.float64)
            keys = np.concatenate([which * 2 * states + beside % states, which * 2 * states + states + beside // states])
            keys, at = np.unique(keys, return_inverse=True)
            times = np.bincount(at, np.concatenate([n, n]))
            starts = np.searchsorted(keys, np.arange(len(words)) * 2 * states)
            best = runs_of_words(keys % (2 * states), times, starts, np.full(len(words), classes), between, classes)
            suffix = suffix_classes(words)
            c = np.bincount(which, n, len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([words, pa.array(best, pa.int32()), pa.array(suffix, pa.int32()), pa.array(c)], names=["word", "class", "suffix", "c"])

    rows = pairs.where("word IS NOT NULL").select("word", "a", "b", "n").mapInArrow(code, "word binary, code int, n bigint")
    # At most states * states neighbours of a word, however often it stands.
    grouped = rows.repartition("word").groupBy("word", "code").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("at"))
    return grouped.mapInArrow(move, "word binary, class int, suffix int, c bigint")


def exchange(bigrams: np.ndarray, clustered: int, classes: int, rounds: int) -> np.ndarray:
    """Class of every row: words move to the class that gains most likelihood, the others keep theirs."""
    fixed = len(bigrams) - clustered
    classes = max(1, min(classes, clustered)) if clustered else 0
    total = classes + fixed
    of = np.concatenate([np.arange(clustered) % max(classes, 1), classes + np.arange(fixed)]).astype(np.int64)
    onto = np.zeros((len(bigrams), total))
    onto[np.arange(len(bigrams)), of] = 1
    between = onto.T @ bigrams @ onto
    for _ in range(rounds):
        moved = 0
        for w in range(clustered):
            own = of[w]
            right = np.bincount(of, bigrams[w], total)
            left = np.bincount(of, bigrams[:, w], total)
            itself = bigrams[w, w]
            right[own] -= itself
            left[own] -= itself
            between[own] -= right
            between[:, own] -= left
            between[own, own] -= itself
            rows, columns = between[:classes], between[:, :classes].T
            gain = (xlogx(rows + right) - xlogx(rows)).sum(1) + (xlogx(columns + left) - xlogx(columns)).sum(1)
            at = np.arange(classes)
            inner = between[at, at]
            gain += xlogx(inner + right[at] + left[at] + itself) - xlogx(inner + right[at]) - xlogx(inner + left[at]) + xlogx(inner)
            row_sum, column_sum = rows.sum(1), columns.sum(1)
            gain -= xlogx(row_sum + right.sum() + itself) - xlogx(row_sum) + xlogx(column_sum + left.sum() + itself) - xlogx(column_sum)
            best = int(np.argmax(gain))
            moved += best != own
            of[w] = best
            between[best] += right
            between[:, best] += left
            between[best, best] += itself
        if not moved:
            break
    return of


@dataclass
class Model:
    words: list[bytes]  # the head, most frequent first
    class_of: np.ndarray  # of head words, then -1 for all others, then the end
    transition: np.ndarray  # log10 P(class | class), the end behind the classes
    below: np.ndarray  # log10 of what a class' counts are divided by
    unseen: np.ndarray  # class of words never seen, by suffix
    emission: np.ndarray  # log10 P(word | class) of head words, then 0
    base: np.ndarray  # log10 of count + 1
    tokens: int
    distinct: int


def most_frequent(counts: DataFrame) -> DataFrame:
    """The most frequent words, HEAD_WORDS at most: those above a count that a histogram gives, so nothing is sorted."""
    short = counts.where(F.octet_length("word") <= HEAD_BYTES)
    level = F.floor(F.log2("c") * 8)
    room, least = HEAD_WORDS, 0
    for lowest, n in short.groupBy(level.alias("level")).agg(F.min("c"), F.count(F.lit(1))).orderBy(F.desc("level")).select("min(c)", "count(1)").collect():
        room -= n  # a row for each level, of which a 64-bit count has 512
        if room < 0:
            break
        least = lowest
    return short.where(F.col("c") >= (least or 1 << 62))


def classes_of_head(pairs: DataFrame, suffix: np.ndarray) -> tuple[np.ndarray, int]:
    """(class of every frequent word, number of classes), by rounds over all of them.

    The first words are exchanged one by one; all others join them at once, then
    each half of the words moves against the other.  Other words and the end
    are states of their own.
    """
    head = len(suffix)
    first = min(CLUSTERED, head)
    rest = np.concatenate([suffix, np.arange(SUFFIX_CLASSES + 1)])
    seeds = np.concatenate([np.arange(first), first + rest[first:]])
    counted = bigram_counts(pairs, seeds, first + SUFFIX_CLASSES + 1)
    of = exchange(counted, first, CLASSES, ROUNDS)[:first]
    classes = max(1, min(CLASSES, first))
    states = classes + SUFFIX_CLASSES + 1
    between = folded(counted, np.concatenate([of, np.arange(classes, states)]), states)
    of = np.concatenate([of, classes + rest[first:]])
    ids = np.arange(len(of))
    for chosen in (ids >= first, ids % 2 == 0, ids % 2 == 1):
        moving = chosen & (ids < head)
        if head > first and moving.any():
            if between is None:
                between = bigram_counts(pairs, of, states)
            found = head_classes(pairs, of, moving, between, classes).toArrow()  # two numbers for each of HEAD_WORDS
            of = of.copy()
            of[found["word"].to_numpy()] = found["class"].to_numpy()
            between = None  # the words have moved
    return of[:head], classes


def tail_transitions(pairs: DataFrame, lexicon: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Counts between classes and the end of all bigrams with a word that is not frequent."""
    sent = pairs.sparkSession.sparkContext.broadcast(of)

    def code(batches):
        for batch in batches:
            a, b = (pa.array(sent.value[batch.column(i).to_numpy()], pa.int32()) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), a, b, batch.column(4)], names=["word", "next", "a", "b", "n"])

    rows = pairs.where("word IS NOT NULL").drop("block").mapInArrow(code, "word binary, next binary, a int, b int, n bigint")
    known = lexicon.select("word", "class")
    # Once per pair: as the word before where the next is frequent or rare, as the word after where the one before is frequent.
    own = rows.join(known, "word")
    beside = F.array(F.when(F.col("a") >= 0, F.struct(F.col("a").alias("x"), F.col("class").alias("y"))), F.when(F.col("b") >= 0, F.struct(F.col("class").alias("x"), F.col("b").alias("y"))))
    single = own.select("n", F.explode(beside).alias("at")).where("at IS NOT NULL").select("at.x", "at.y", "n")
    both = own.where("next IS NOT NULL").groupBy("next", F.col("class").alias("x")).agg(F.sum("n").alias("n"))
    double = both.join(known.withColumnRenamed("word", "next"), "next").select("x", F.col("class").alias("y"), "n")
    counts = np.zeros((classes + 1, classes + 1))
    for x, y, n in single.unionByName(double).groupBy("x", "y").agg(F.sum("n")).collect():  # a row for each pair of classes
        counts[x, y] += n
    return counts


def fit(texts: DataFrame, counts: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the training `texts`, whose word counts are `counts`, and (word, class, suffix, c) of all words that are not in its head."""
    n_docs = texts.count()
    sums = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    head = most_frequent(counts).toArrow()  # at most HEAD_WORDS words of HEAD_BYTES
    ranked = sorted(zip((-head["c"].to_numpy()).tolist(), head["word"].to_pylist(), head["suffix"].to_pylist()))
    words, c = [r[1] for r in ranked], -np.array([r[0] for r in ranked], np.float64)
    suffix = np.array([r[2] for r in ranked], np.int64)
    pairs = cut_lineage(neighbours(texts, words), "neighbours")
    of, classes = classes_of_head(pairs, suffix)
    states, size = classes + SUFFIX_CLASSES + 1, len(words)
    now = np.concatenate([of, np.arange(classes, states)])
    among = bigram_counts(pairs, now, states)
    lexicon = cut_lineage(tail_classes(pairs, now, among, classes), "lexicon")
    # From here on every word stands in its class, and only the end beside the classes.
    class_of = np.concatenate([of, np.full(SUFFIX_CLASSES, -1), [classes]])
    kept = np.append(np.arange(classes), states - 1)
    between = among[np.ix_(kept, kept)] + tail_transitions(pairs, lexicon, class_of, classes)
    discard(pairs)
    share = (between.sum(0) + 1) / (between.sum() + classes + 1)
    transition = np.log10((between + PRIOR * share) / (between.sum(1, keepdims=True) + PRIOR))
    mass, kinds = np.bincount(of, c, classes), np.zeros((SUFFIX_CLASSES, classes))
    np.add.at(kinds, (suffix, of), 1)
    for s, k, tokens, distinct in lexicon.groupBy("suffix", "class").agg(F.sum("c"), F.count(F.lit(1))).collect():
        mass[k] += tokens
        kinds[s, k] += distinct
    # Suffixes that no word has go by all words.
    unseen = np.where(kinds.any(1, keepdims=True), kinds, kinds.sum(0)).argmax(1)
    below = np.log10(np.maximum(mass + ADDED * (kinds.sum(0) + np.isin(np.arange(classes), unseen)), ADDED))
    emission = np.concatenate([np.log10(c + ADDED) - below[of], np.zeros(SUFFIX_CLASSES + 1)])
    base = np.concatenate([np.log10(c + 1), np.zeros(SUFFIX_CLASSES), [np.log10(n_docs + 1)]])
    assert len(class_of) == size + SUFFIX_CLASSES + 1
    return Model(words, class_of, transition, below, unseen, emission, base, int(sums[0] or 0) + n_docs, sums[1] + (n_docs > 0)), lexicon


def looked_up(values: np.ndarray, at: Column) -> Column:
    """The number at a place of a short array."""
    return F.element_at(F.split(F.lit(",".join(map(repr, values.ravel().tolist()))), ",").cast("array<double>"), (at + 1).cast("int"))


def class_ngrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, folds: int = 7, fold: int = 2) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from all rows outside fold `fold`; null text is empty and has its
    end as only token; rows repeated with one id are scored each.  If nothing
    is left to learn from, every token is unknown and scores are finite.
    """
    source = id_and_bytes(docs, id_col, text_col).withColumn("held", fold_of(F.col("id"), folds) == fold)
    training = source.where(~F.col("held"))
    counts = cut_lineage(word_counts(training), "word-counts")
    model, lexicon = fit(training, counts)
    discard(counts)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # Row numbers hold within this one pass; id and fold travel with it.
    fields = [("row", pa.int64()), ("word", pa.binary()), ("tf", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("next", pa.binary()), ("at", pa.int32())]
    wide, most = len(model.below) + 2, SUFFIX_CLASSES

    def rows_of(id_kind, **columns):
        n = len(columns["row"])
        kinds = [*fields, ("id", id_kind), ("held", pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind) for name, kind in kinds], names=[name for name, _ in kinds])

    def compute(batches):
        m = sent.value
        head, end = pa.array(m.words, pa.binary()), len(m.class_of) - 1
        known_end = int(m.base[end] > 0)

        def own(rows):
            """A key of its own, which is no word, spreads these rows."""
            return pc.binary_join_element_wise("", rows.cast(pa.string()), " ").cast(pa.binary())

        for piece in texts_at_once(batches, 1):
            rows, texts, ids, held = piece.columns
            words, counts = split_words(texts)
            found = word_ids(words, head)
            seq, places = in_a_row(found, counts, end)
            after, classes = seq[1:], m.class_of[seq]
            rare = classes < 0
            sure = ~(rare[:-1] | rare[1:])
            token_of = np.repeat(np.arange(len(rows)), counts + 1)

            def summed(values, token_of=token_of, n=len(rows)):
                return np.bincount(token_of, values, n)

            score = summed(np.where(sure, m.transition[classes[:-1], classes[1:]], 0) + m.emission[after])
            known = summed(after < len(head)).astype(np.int64) + known_end
            key = own(rows)
            yield rows_of(ids.type, row=rows, word=key, tf=counts + 1, known=known, base=summed(m.base[after]), score=score, next=key, at=np.zeros(len(rows), np.int32), id=ids, held=held)
            tail = np.flatnonzero(found >= len(head))
            if len(tail):
                at = places[tail]
                follows = rare[at + 1]
                # The classes on both sides, 0 where they are to be joined, and the suffixes of the word and the next.
                sides = (classes[at - 1] + 1) * wide + classes[at + 1] + 1
                codes = (sides * most + seq[at] - len(head)) * most + np.where(follows, seq[at + 1] - len(head), 0)
                of_row = rows.take(pa.array(np.repeat(np.arange(len(rows)), counts)[tail]))
                beside = counted_rows({"row": of_row, "word": words.take(pa.array(tail)), "next": next_words(words, tail, follows), "at": codes.astype(np.int32)})
                for part in beside.to_batches(50_000):
                    row, word, following, code, tf = part.columns
                    yield rows_of(ids.type, row=row, word=word, tf=tf, next=pc.coalesce(following, own(row)), at=code)

    numbered = source.withColumn("row", F.monotonically_increasing_id())
    kind = id_type(docs, id_col)
    parts = numbered.select("row", "text", "id", "held").mapInArrow(
        compute, f"row bigint, word binary, tf bigint, known bigint, base double, score double, next binary, at int, id {kind}, held boolean"
    )
    own = F.col("known").isNotNull()
    after, word = F.col("at") % most, F.floor(F.col("at") / most) % most
    right, left = F.floor(F.col("at") / most**2) % wide, F.floor(F.col("at") / (most**2 * wide))
    known = lexicon.select("word", "c", "class")
    first = parts.join(known, "word", "left").withColumns({"c": F.coalesce("c", F.lit(0)), "class": F.coalesce("class", looked_up(model.unseen, word).cast("int"))})

    def step(x, y):
        return looked_up(model.transition, x * len(model.transition) + y)

    shares = F.log10(F.col("c") + ADDED) - looked_up(model.below, F.col("class")) + F.when(left > 0, step(left - 1, F.col("class"))).otherwise(0) + F.when(right > 0, step(F.col("class"), right - 1)).otherwise(0)
    weighed = first.select(
        "row", "id", "held", "next", after.alias("after"),
        F.when(~own & (right == 0), F.col("class")).alias("class"),
        F.when(~own & (right == 0), F.col("tf")).alias("tf"),
        F.when(own, F.col("tf")).alias("n_tokens"),
        F.when(own, F.col("known")).otherwise(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.when(own, F.col("base")).otherwise(F.col("tf") * F.log10(F.col("c") + 1)).alias("base"),
        F.when(own, F.col("score")).otherwise(F.col("tf") * shares).alias("score"),
    )
    # Two words in a row that are not frequent: the class of the next is joined too.
    following = known.select(F.col("word").alias("next"), F.col("class").alias("next_class"))
    pair = step(F.col("class"), F.coalesce("next_class", looked_up(model.unseen, F.col("after")).cast("int")))
    sums = (
        weighed.join(following, "next", "left")
        .groupBy("row")
        .agg(
            F.first("id", True).alias("id"),
            F.first("held", True).alias("held"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum("n_known").alias("n_known"),
            F.sum("base").alias("base"),
            F.sum(F.col("score") + F.when(F.col("class").isNotNull(), F.col("tf") * pair).otherwise(0)).alias("score"),
        )
    )
    denominator = float(np.log10(model.tokens + model.distinct + 1))
    return sums.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * denominator).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
