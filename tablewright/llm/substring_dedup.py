"""Repeated passages: winnowed anchors seed matches, which are extended over whole windows.

A window is `window` consecutive words.  Winnowing picks one 8-word gram of
every window, the same one wherever the window stands; so equal windows meet
at an anchor.  An anchor seen more than once is compared with its first
occurrence, as far to the left and right as the windows it stands for reach.
The few windows that differ from that first occurrence are grouped by
themselves.  Runs of windows that start earlier make the maximal repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.texts import MIX, WordHashes, gram_hashes, id_and_bytes, id_type, mixed
from tablewright.storage import cut_lineage

GRAM = 8
#: Bits of the filter of repeated anchors that goes to every task: fixed, whatever the corpus holds.
FILTER_WORDS = 1 << 20
#: An anchor stands for fewer windows than this.
RUN = 256


def first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in every run of `width`, by runs of doubled length."""
    low, places, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        right = low[step:] < low[:-step]
        low, places = np.where(right, low[step:], low[:-step]), np.where(right, places[step:], places[:-step])
        span += step
    return places


def runs_of(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of each chosen place; places never go back."""
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    return first, np.diff(first, append=len(chosen))


def anchored(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(chosen gram of each window, gram hashes)."""
    grams = gram_hashes(words, GRAM)
    width = window - GRAM + 1
    if len(grams) < width:
        return np.empty(0, np.int64), grams
    return first_smallest(grams, width), grams


def window_hashes(grams: np.ndarray, n: int, window: int) -> np.ndarray:
    """A hash of each of the first n windows, from the grams that cover it."""
    hashes = np.zeros(n, np.uint64)
    for at in [*range(0, window - GRAM, GRAM), window - GRAM] if n else []:
        hashes = hashes * MIX + grams[at : at + n]
    return mixed(hashes)


def repeated_anchors(texts: DataFrame, window: int) -> DataFrame:
    """(anchor) of the grams chosen at more than one place."""

    def count(batches):
        words = WordHashes()
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                chosen, grams = anchored(words.array(text.split()), window)
                found.append(grams[chosen[runs_of(chosen)[0]]])
            values, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    counts = texts.select("text").mapInArrow(count, "anchor bigint, n bigint")
    return counts.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def anchor_filter(anchors: DataFrame) -> np.ndarray:
    """A bit table in which every given anchor has its bit set; others may share it."""
    slot = F.shiftrightunsigned("anchor", 6).bitwiseAND(F.lit(FILTER_WORDS - 1))
    bit = F.expr("shiftleft(1L, cast(anchor & 63 as int))")
    found = anchors.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(FILTER_WORDS, np.int64)
    table[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint64)


def occurrences(texts: DataFrame, window: int, kind: str) -> DataFrame:
    """(anchor, id, row, start, hashes): each anchor that may be repeated, with the hashes of its windows from word `start` on."""
    sent = texts.sparkSession.sparkContext.broadcast(anchor_filter(repeated_anchors(texts, window)))

    def find(batches):
        words, table = WordHashes(), sent.value
        for batch in batches:
            taken, anchors, starts, counts, hashes = [], [], [], [], []
            for at, text in enumerate(batch.column(2).to_pylist()):
                chosen, grams = anchored(words.array(text.split()), window)
                first, n = runs_of(chosen)
                values = grams[chosen[first]]
                slots = ((values >> np.uint64(6)) & np.uint64(FILTER_WORDS - 1)).astype(np.int64)
                keep = (table[slots] >> (values & np.uint64(63))) & np.uint64(1) == 1
                taken.append(np.full(np.count_nonzero(keep), at, np.int32))
                anchors.append(values[keep].view(np.int64))
                starts.append(first[keep].astype(np.int32))
                counts.append(n[keep])
                hashes.append(window_hashes(grams, len(chosen), window)[np.repeat(keep, n)].view(np.int64))
            if not taken:
                continue
            of = pa.array(np.concatenate(taken))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(hashes)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(anchors)), batch.column(0).take(of), batch.column(1).take(of), pa.array(np.concatenate(starts)), runs],
                names=["anchor", "id", "row", "start", "hashes"],
            )

    return texts.select("id", "row", "text").mapInArrow(find, f"anchor bigint, id {kind}, row bigint, start int, hashes array<bigint>")


def repeats(texts: DataFrame, window: int, kind: str) -> DataFrame:
    """(id, row, runs): the windows of a text that also start earlier, each run as first window * RUN + their number."""
    seen = occurrences(texts, window, kind)
    # An anchor's place is told by the first of its windows: that orders the occurrences as the windows are.
    place = F.struct("id", "start")
    firsts = seen.groupBy("anchor").agg(F.min(place).alias("first"), F.min_by("hashes", place).alias("first_hashes"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # First occurrences are written before they are joined: adaptive execution splits a hot key
    # only where both sides come straight from a shuffle, not from an aggregate behind one.
    firsts = cut_lineage(firsts.drop("n"), "first-occurrences")
    later = seen.join(firsts, "anchor").where(place > F.col("first"))
    each = F.transform("hashes", lambda h, i: F.struct((F.col("start") + i).alias("start"), h.alias("hash"), F.array_contains("first_hashes", h).alias("matched")))
    rest = F.transform(F.filter(each, lambda w: ~w["matched"]), lambda w: F.struct(w["start"].alias("start"), w["hash"].alias("hash")))
    single = F.transform(F.filter(each, lambda w: w["matched"]), lambda w: w["start"].cast("bigint") * RUN + 1)
    runs = F.when(F.forall(each, lambda w: w["matched"]), F.array(F.col("start").cast("bigint") * RUN + F.size("hashes"))).otherwise(single)
    compared = cut_lineage(later.select("anchor", "id", "row", runs.alias("runs"), rest.alias("rest")), "compared-anchors")
    windows = compared.where("size(rest) > 0").select("anchor", "id", "row", F.inline("rest"))
    own = windows.groupBy("anchor", "hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    own = cut_lineage(own, "first-windows")
    further = windows.join(own, ["anchor", "hash"]).where(place > F.col("first")).select("id", "row", F.array(F.col("start").cast("bigint") * RUN + 1).alias("runs"))
    found = compared.where("size(runs) > 0").select("id", "row", "runs").unionByName(further)
    return cut_lineage(found.groupBy("id", "row").agg(F.flatten(F.collect_list("runs")).alias("runs")), "repeats")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window over it also starts earlier: in a document of a
    smaller id, or further up in the same one.  A null id comes before all
    others; rows repeated with one id are the same place, so neither removes
    the other.  Null and empty texts have no words and the digest of nothing.
    """
    if not 2 * GRAM <= window < RUN:
        raise ValueError(f"a window takes {2 * GRAM} to {RUN - 1} words")
    texts = id_and_bytes(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    kind = id_type(docs, id_col)
    found = repeats(texts, window, kind)

    def cut(batches):
        for batch in batches:
            n_words, n_removed, digest, kept = [], [], [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.split()
                if runs:
                    packed = np.asarray(runs)
                    first = packed // RUN
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + packed % RUN - 1 + window, -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                else:
                    left = words
                line = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                digest.append(hashlib.sha256(line).hexdigest())
                kept.append(line)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                names=["id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    # Id and text hash name a text; repeated rows are the same text.  At every size both sides are dealt out
    # by them and the runs, one row a text, are hashed, so texts are never sorted.
    found = found.withColumnRenamed("id", "of").withColumnRenamed("row", "hash").hint("shuffle_hash")
    joined = texts.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("hash")), "left").select("id", "text", "runs")
    out = joined.mapInArrow(cut, f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text binary")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", F.col("kept_text").cast("string").alias("kept_text"))
