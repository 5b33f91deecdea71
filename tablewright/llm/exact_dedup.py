"""Exact duplicates: counting quotient filters find repeated fingerprints, bytes decide.

Every task builds counting quotient filters over the 64-bit fingerprints it
sees, one per block of the fingerprint space.  The filters of a block are
merged without loss, since a filter lists its fingerprints in order.  Only
texts whose merged count is above one are compared byte by byte.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.texts import id_and_text
from tablewright.storage import cut_lineage

#: Fingerprints a merged block holds on average, and the fewest blocks (as a power of two).
BLOCK_FINGERPRINTS, LEAST_BLOCK_BITS = 1 << 20, 6
#: Fingerprints one task keeps before it writes its filters out.
TASK_FINGERPRINTS = 1 << 20
#: A fingerprint of more than one row in HOT_SHARE is dealt over HOT_SALTS tasks; fewer than HOT_SHARE of them exist.
HOT_SHARE, HOT_SALTS = 1000, 64

FILTER = pa.schema(
    [
        ("block", pa.int32()),
        ("quotient_bits", pa.int32()),
        ("occupied", pa.binary()),  # a bit per quotient
        ("run_ends", pa.binary()),  # a bit per slot
        ("remainders", pa.binary()),  # sorted within a run
        ("counted", pa.binary()),  # slots with a count above one ...
        ("counts", pa.binary()),  # ... and these counts
    ]
)
FILTER_DDL = "block int, quotient_bits int, occupied binary, run_ends binary, remainders binary, counted binary, counts binary"


def encode(block: int, low: np.ndarray, counts: np.ndarray, low_bits: int) -> tuple:
    """The filter of sorted distinct values of `low_bits` bits and their counts."""
    quotient_bits = min(low_bits - 1, max(3, math.ceil(math.log2(len(low) + 1))))
    remainder_bits = low_bits - quotient_bits
    quotients = (low >> np.uint64(remainder_bits)).astype(np.int64)
    remainders = low & np.uint64((1 << remainder_bits) - 1)
    occupied = np.zeros(1 << quotient_bits, np.uint8)
    occupied[quotients] = 1
    ends = np.append(quotients[1:] != quotients[:-1], True)
    width = (remainder_bits + 7) // 8
    packed = remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    many = np.flatnonzero(counts > 1)
    return (
        block,
        quotient_bits,
        np.packbits(occupied).tobytes(),
        np.packbits(ends).tobytes(),
        packed.tobytes(),
        many.astype("<u4").tobytes(),
        counts[many].astype("<i8").tobytes(),
    )


def decode(row: tuple, low_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted values of a filter and their counts."""
    _, quotient_bits, occupied, run_ends, packed, counted, extra = row
    remainder_bits = low_bits - quotient_bits
    width = (remainder_bits + 7) // 8
    slots = np.frombuffer(packed, np.uint8).reshape(-1, width)
    whole = np.zeros((len(slots), 8), np.uint8)
    whole[:, :width] = slots
    remainders = whole.view("<u8").ravel()
    ends = np.unpackbits(np.frombuffer(run_ends, np.uint8), count=len(slots))
    run = np.cumsum(ends) - ends
    quotients = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, np.uint8)))[run]
    counts = np.ones(len(slots), np.int64)
    counts[np.frombuffer(counted, "<u4")] = np.frombuffer(extra, "<i8")
    return (quotients.astype(np.uint64) << np.uint64(remainder_bits)) | remainders, counts


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values with their counts added up."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return values[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _filters(values: np.ndarray, low_bits: int):
    values, counts = summed(values, np.ones(len(values), np.int64))
    blocks = (values >> np.uint64(low_bits)).astype(np.int64)
    low = values & np.uint64((1 << low_bits) - 1)
    cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    for start, end in zip(cuts, np.append(cuts[1:], len(values))):
        yield encode(int(blocks[start]), low[start:end], counts[start:end], low_bits)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FILTER)], schema=FILTER)


def counting_filters(fingerprints: DataFrame, block_bits: int) -> DataFrame:
    """Filters of the one bigint column, some for each task."""
    low_bits = 64 - block_bits

    def build(batches):
        kept, size = [], 0
        for batch in batches:
            kept.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            size += len(kept[-1])
            if size >= TASK_FINGERPRINTS:
                yield _as_batch(list(_filters(np.concatenate(kept), low_bits)))
                kept, size = [], 0
        if size:
            yield _as_batch(list(_filters(np.concatenate(kept), low_bits)))

    return fingerprints.mapInArrow(build, FILTER_DDL)


def merged_filters(filters: DataFrame, block_bits: int) -> DataFrame:
    """One filter per block, holding every fingerprint with its whole count."""
    low_bits = 64 - block_bits

    def merge(key, table):
        parts = [decode(tuple(row.values()), low_bits) for row in table.select(FILTER.names).to_pylist()]
        values, counts = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return pa.Table.from_batches([_as_batch([encode(key[0].as_py(), values, counts, low_bits)])])

    return filters.groupBy("block").applyInArrow(merge, FILTER_DDL)


def repeated(filters: DataFrame, block_bits: int) -> DataFrame:
    """(fp, count) of the fingerprints counted more than once."""
    low_bits = 64 - block_bits

    def listed(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values, counts = decode(tuple(row[n] for n in FILTER.names), low_bits)
                values = (values[counts > 1] | np.uint64(row["block"] << low_bits)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts[counts > 1])], names=["fp", "count"])

    return filters.mapInArrow(listed, "fp bigint, count bigint")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256.

    Of rows with identical texts the one with the largest id stays; null text
    counts as empty.  Rows repeated with the same id all count, and all are
    kept if that id is the largest.  A null id is smaller than any other.  An
    empty table gives an empty result; further columns are ignored.
    """
    base = id_and_text(docs, id_col, text_col).withColumn("fp", F.xxhash64("text"))
    rows = base.count()
    block_bits = max(LEAST_BLOCK_BITS, math.ceil(math.log2(rows / BLOCK_FINGERPRINTS + 1)))
    filters = merged_filters(counting_filters(base.select("fp"), block_bits), block_bits)
    seen_twice = cut_lineage(repeated(filters, block_bits), "repeated-fingerprints")

    is_hot = F.col("count") * HOT_SHARE > rows
    hot = seen_twice.where(is_hot).select("fp", F.lit(True).alias("hot"))  # fewer than HOT_SHARE rows
    dealt = base.join(F.broadcast(hot), "fp", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.hash("id"), F.lit(HOT_SALTS))).otherwise(0)
    )
    wanted = seen_twice.select(
        "fp", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    )
    groups = (
        dealt.join(wanted, ["fp", "salt"], "left_semi")
        .groupBy("fp", "text", "salt")
        .agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
        .groupBy("fp", "text")
        .agg(F.max("top").alias("keep"), F.sum("n").alias("size"))
        .where("size > 1")
        .select("fp", F.sha2("text", 256).alias("sha"), "keep", "size")
    )
    found = base.select("id", "fp", F.sha2("text", 256).alias("sha")).join(groups, ["fp", "sha"], "left")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
