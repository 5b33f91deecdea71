"""Near duplicates by SimHash, found by multi-index hashing.

Two 64-bit fingerprints that differ in at most two bits differ in at most one
bit of their upper half, or not at all in their lower half.  So every
fingerprint looks up the Hamming ball of radius one around its upper half and
its lower half itself, and the whole distance of what it finds is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import connected
from tablewright.llm.texts import id_and_bytes, id_type
from tablewright.storage import cut_lineage

SEED = 42
#: Shingle hashes whose bits are counted at once.
BIT_ROWS = 1 << 14


def fingerprint(text: bytes, n: int) -> int:
    """The SimHash of the text's n-word shingles, A-Z lowered; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= n:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())]
    values = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), BIT_ROWS):
        ones += np.unpackbits(values[at : at + BIT_ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, n: int = 3) -> DataFrame:
    """(id, fp) of every row."""

    def compute(batches):
        for batch in batches:
            found = [fingerprint(text, n) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(compute, f"id {id_type(docs, id_col)}, fp bigint")


def links(points: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids whose distinct fingerprints differ in one or two bits; points: (id, fp)."""
    upper = F.shiftrightunsigned("fp", 32)
    lower = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    table = points.select("id", "fp", F.explode(F.array(F.struct(F.lit(0).alias("segment"), upper.alias("key")), F.struct(F.lit(1).alias("segment"), lower.alias("key")))).alias("at")).select("id", "fp", "at.*")
    # A pair whose upper halves differ in one bit is found from the side where this bit is 0.
    flips = [F.when(upper.bitwiseAND(F.lit(1 << bit)) == 0, F.struct(F.lit(0).alias("segment"), upper.bitwiseOR(F.lit(1 << bit)).alias("key"))) for bit in range(32)]
    probes = F.filter(
        F.array(F.struct(F.lit(0).alias("segment"), upper.alias("key")), F.struct(F.lit(1).alias("segment"), lower.alias("key")), *flips),
        lambda p: p.isNotNull(),
    )
    asked = points.select(F.col("id").alias("a"), F.col("fp").alias("fp_a"), F.explode(probes).alias("at")).select("a", "fp_a", "at.*")
    met = asked.join(table.select(F.col("id").alias("b"), F.col("fp").alias("fp_b"), "segment", "key"), ["segment", "key"])
    same_key = F.col("fp_a") < F.col("fp_b")
    flipped = F.shiftrightunsigned("fp_a", 32) != F.shiftrightunsigned("fp_b", 32)
    verified = met.where(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= 2).where(
        F.when((F.col("segment") == 0) & flipped, True).otherwise(same_key)
    )
    return verified.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id.

    The component is the smallest id reachable over links of at most two bits.
    Texts without words have fingerprint zero and are linked like any other;
    a text of fewer than n words is one shingle.  Rows repeated with one id
    share its component; rows with a null id have a null component of their
    own unless others share their fingerprint.  Empty tables give no rows.
    """
    marks = cut_lineage(fingerprints(docs, id_col, text_col, n), "fingerprints")
    points = cut_lineage(marks.groupBy("fp").agg(F.min("id").alias("id")), "distinct-fingerprints")
    edges = cut_lineage(links(points.where("id is not null")), "simhash-links")
    labels = connected(edges)
    groups = points.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "fp", F.coalesce("component", "id").alias("component")
    )
    return marks.join(groups, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )
