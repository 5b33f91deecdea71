"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every n-gram of a test item is a seed, however common: a document that holds
one is aligned, word by word, with the items the seed comes from, unless it
has too few of an item's words there for any alignment to reach the score.
The alignment score finds copies with words changed, left out or put in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.texts import WordHashes, gram_hashes, id_and_bytes, id_type
from tablewright.storage import cut_lineage

GRAM = 3
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Share of an item's words that the alignment has to reach, and the words that are no chance.
LEAST_SCORE, LEAST_WORDS = 0.5, 6
#: Item bytes that go to every task at once; a larger benchmark is searched in blocks, one pass each.
BLOCK_BYTES = 16 << 20
#: ASCII punctuation is left out of words.
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SIEVE_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(None, PUNCTUATION).split()


def gram_size(n_words: int) -> int:
    return max(1, min(GRAM, n_words))


@dataclass
class Block:
    ids: list
    words: list[np.ndarray]  # word hashes of each item
    grams: np.ndarray  # sorted distinct seed hashes
    first: np.ndarray  # where the items of a seed begin in `items`
    items: np.ndarray
    sieve: np.ndarray

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, seed numbers) of the seeds among a document's grams."""
        at = np.flatnonzero(self.sieve[(grams & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)])
        seed = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        real = self.grams[seed] == grams[at]
        return at[real], seed[real]


def block_of(rows: list[tuple]) -> Block | None:
    """Items and their seeds; None if no item has words."""
    hashes = WordHashes()
    words = [hashes.array(words_of(text)) for _, text in rows]
    pairs = [(int(g), i) for i, w in enumerate(words) if len(w) for g in set(gram_hashes(w, gram_size(len(w))).tolist())]
    if not pairs:
        return None
    pairs.sort()
    grams, first = np.unique(np.array([g for g, _ in pairs], np.uint64), return_index=True)
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[(grams & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)] = True
    return Block([r[0] for r in rows], words, grams, np.append(first, len(pairs)), np.array([i for _, i in pairs], np.int64), sieve)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """The best local alignment: its score, and the passage word it ends at."""
    best, end = 0.0, -1
    along = -GAP * np.arange(1, len(passage) + 1)
    above = np.zeros(len(passage) + 1)
    for word in item:
        row = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum(row, 0.0)
        row = np.maximum.accumulate(row + along) - along  # gaps in the item
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at
        above = np.append(0.0, row)
    return best, end


def needed(n_words: int) -> float:
    return min(n_words, max(LEAST_SCORE * n_words, LEAST_WORDS))


def matches(words: np.ndarray, block: Block):
    """(item number, score, start, end) of the items a document holds; one, the best, for each item."""
    at_all, seed_all = [], []
    for n in range(1, GRAM + 1):
        at, seed = block.hits(gram_hashes(words, n))
        at_all.append(at)
        seed_all.append(seed)
    at, seed = np.concatenate(at_all), np.concatenate(seed_all)
    if not len(at):
        return
    counts = block.first[seed + 1] - block.first[seed]
    place = np.repeat(at, counts)
    item = block.items[np.concatenate([np.arange(block.first[s], block.first[s + 1]) for s in seed])]
    order = np.lexsort((place, item))
    place, item = place[order], item[order]
    for cut in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
        own = block.words[item[cut[0]]]
        size, best = len(own), (0.0, 0, 0)
        # Places further apart than the item can reach are passages of their own.
        for run in np.split(place[cut], np.flatnonzero(np.diff(place[cut]) > 2 * size) + 1):
            low, high = max(0, int(run[0]) - 2 * size), int(run[-1]) + 2 * size + GRAM
            passage = words[low:high]
            # Each matching word scores one, so the words in common bound the score.
            common = np.isin(passage, own)
            if common.sum() < needed(size) or np.isin(own, passage[common]).sum() < needed(size):
                continue
            score, end = align(own, passage)
            if score > best[0] and score >= needed(size):
                back, start = align(own[::-1], passage[: end + 1][::-1])
                best = (score, low + end - start, low + end + 1)
        if best[0]:
            yield int(item[cut[0]]), best[0] / size, best[1], best[2]


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document and item it holds: id, item, score, start_word, end_word.

    Score is the alignment score over the item's words; at least LEAST_SCORE
    of them, and LEAST_WORDS words, must be reached (shorter items: all).
    Case and ASCII punctuation do not count.  Null and empty texts and items
    without words match nothing; a repeated row gives repeated results.
    """
    source = id_and_bytes(docs, id_col, text_col)
    items = id_and_bytes(benchmark, item_col, item_text).where("id is not null").dropDuplicates(["id", "text"])
    kind, item_kind = id_type(docs, id_col), id_type(benchmark, item_col)
    size = items.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    blocks = -(-2 * (size[0] or 0) // BLOCK_BYTES) or 1
    ddl = f"id {kind}, item {item_kind}, score double, start_word bigint, end_word bigint"
    results = None
    for number in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == number) if blocks > 1 else items
        found = part.toArrow()
        rows = sorted(zip(found["id"].to_pylist(), found["text"].to_pylist()))
        block = block_of(rows)
        if block is None:
            continue
        item_type = found.schema.field("id").type
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches, sent=sent, item_type=item_type):
            b, hashes = sent.value, WordHashes()
            for batch in batches:
                at, out = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for m in matches(hashes.array(words_of(text)), b):
                        at.append(i)
                        out.append(m)
                item, score, start, end = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int32())), pa.array([b.ids[i] for i in item], item_type), pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                    names=["id", "item", "score", "start_word", "end_word"],
                )

        one = source.mapInArrow(search, ddl)
        results = one if results is None else results.unionByName(one)
    if results is None:
        results = docs.sparkSession.createDataFrame([], ddl)
    return cut_lineage(results, "contaminations").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score", "start_word", "end_word")
