"""What the operators share: whole texts as bytes, words, word hashes, Arrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

#: Bytes that end a word: space and \t \n \v \f \r, which is also what bytes.split() takes.
WORD = r"[^\x20\x09-\x0D]+"

#: Entries a per-task word table may reach before it is started anew.
CACHE_WORDS = 1_000_000

#: Numbers of 64 bits in a sieve, which goes to every task: fixed, whatever the tables hold.
SIEVE_WORDS = 1 << 20

MIX = np.uint64(0x9E3779B97F4A7C15)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns `id` and `text` alone, so no further column can clash; null text is empty."""
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def id_and_bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As `id_and_text`, with the UTF-8 bytes."""
    return id_and_text(docs, id_col, text_col).select("id", F.col("text").cast("binary").alias("text"))


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.select(id_col).schema[0].dataType.simpleString()


def fold_of(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Values with every bit spread over all others (the splitmix finaliser)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for i in range(n):
        total = total * MIX + words[i : i + count]
    return mixed(total)


def sieve(marks: DataFrame) -> np.ndarray:
    """A table of bits in which that of every given `mark`, a 64-bit hash, is set; others may share it.  Its size is fixed."""
    slot = F.shiftrightunsigned("mark", 6).bitwiseAND(F.lit(SIEVE_WORDS - 1))
    bit = F.expr("shiftleft(1L, cast(mark & 63 as int))")
    found = marks.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(SIEVE_WORDS, np.int64)
    table[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return table


def may_be_among(marks: DataFrame, mark: Column) -> Column:
    """Whether a row's `mark` may be one of `marks`: never false where it is, so rows without it need not be joined with them."""
    sent = marks.sparkSession.sparkContext.broadcast(sieve(marks))

    def passes(column):
        values = column.to_numpy(zero_copy_only=False).view(np.uint64)
        slots = ((values >> np.uint64(6)) & np.uint64(SIEVE_WORDS - 1)).astype(np.int64)
        return pa.array((sent.value.view(np.uint64)[slots] >> (values & np.uint64(63))) & np.uint64(1) == 1)

    return F.arrow_udf(passes, "boolean", functionType=ArrowUDFType.SCALAR)(mark)


def rows_of(batches: Iterator[pa.RecordBatch], text_at: int = 1) -> Iterator[tuple]:
    """(id, text) of every row, a batch at a time."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(text_at).to_pylist())


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows back as batches of bounded length."""
    columns: list[list] = [[] for _ in schema]
    for row in rows:
        for column, value in zip(columns, row):
            column.append(value)
        if len(columns[0]) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            columns = [[] for _ in schema]
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
