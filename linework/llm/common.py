"""Helpers that the operators share: broadcasts and joins of bounded size, runs of texts, words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.sources.scratch import save

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: digits, lower-case letters and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The characters that no word has, capitals apart.
BETWEEN = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Tables up to this many bytes may be broadcast; above it Spark shuffles both sides.
BROADCAST_BYTES = 16 * 1024 * 1024
#: A key of more rows than this is hot: its facts don't travel by the key.
HOT_ROWS = 1_000_000
#: Bits of a hash that a bitmap of known hashes tells apart: 8 KB in the plan, however many are known.
PREFIX_BITS = 16
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1500


def checked_broadcast(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """A broadcast hint if df (a saved or small table) is counted and fits; else df, for a shuffled join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def join_hot(rows: DataFrame, facts: DataFrame, key: str, total: int, row_bytes: int = 64) -> DataFrame:
    """rows, total of them, joined on key with facts, which have one row a key and in n how many rows it has.

    Keys of over HOT_ROWS rows are few (one in HOT_ROWS rows at most), so their facts are broadcast,
    counted first, and their rows stay where they are; the other keys are shuffled as usual.
    """
    if total <= HOT_ROWS:
        return rows.join(facts, key)
    hot = save(facts.where(F.col("n") > HOT_ROWS), "hot")
    hot = checked_broadcast(hot, row_bytes)
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col("n") <= HOT_ROWS), key)
    return rows.join(hot, key).unionByName(rest)


def join_skewed(rows: DataFrame, facts: DataFrame, keys: list[str], facts_bytes: int) -> DataFrame:
    """rows joined on keys with facts of about facts_bytes bytes: broadcast if they fit.

    Else the rows of each key are counted; the facts of keys of over HOT_ROWS rows, which are few, are broadcast (their
    rows stay where they are), and the others are shuffled.
    """
    if facts_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(facts), keys)
    rows = save(rows, "skewed")
    hot = save(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select(*keys), "hot")
    known = F.broadcast(hot)  # one row in HOT_ROWS at most
    return rows.join(F.broadcast(facts.join(known, keys, "left_semi")), keys).unionByName(rows.join(known, keys, "left_anti").join(facts.join(known, keys, "left_anti"), keys))


def prefix_bitmap(prefixes: Iterable[int]) -> Column:
    """A bitmap, as an array of 64-bit words, of hash prefixes of PREFIX_BITS bits."""
    held = [0] * ((1 << PREFIX_BITS) // 64)
    for n in prefixes:
        held[n // 64] |= 1 << n % 64
    return F.array(*(F.lit(x - (1 << 64) * (x >> 63)).cast("long") for x in held))


def in_bitmap(prefix: Column, bitmap: Column) -> Column:
    """Whether the bitmap knows a prefix: no false negatives, so what it refuses can't join."""
    return F.getbit(F.get(bitmap, F.shiftright(prefix, 6).cast("int")), prefix.bitwiseAND(F.lit(63)).cast("int")) == 1


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the rows of an Arrow batch to BATCH_ROWS where that setting stands at Spark's default.

    A batch is held whole by the JVM and by Python, and the default's 10,000 texts may be very long.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df


def runs_of(texts: pa.Array, size: int = 4_000_000, most: int = 8192) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows of about size bytes and at most that many rows; a longer text is one alone."""
    at, total = 0, 0
    for n, x in enumerate(pc.binary_length(texts).to_pylist()):
        x = x or 0
        if n > at and (total + x > size or n - at >= most):
            yield at, n
            at, total = n, 0
        total += x
    if at < len(texts):
        yield at, len(texts)


def with_text(docs: DataFrame, columns: list[Column], text_col: str, results: tuple[str, ...], text_in: str | None = None) -> tuple[DataFrame, list[str], Callable[[pa.RecordBatch], pa.Array]]:
    """What a Python step reads: (rows, names of the columns it hands on, a function from a batch to its texts).

    Of columns, those named like a result give way to it.  The text follows them as a column of its
    own, unless text_in names one of them that is a struct with the text, which then goes once.
    """
    named = docs.select(*columns).columns
    keep, names = [], []
    for c, n in zip(columns, named, strict=True):
        if n.lower() not in results:
            keep.append(c)
            names.append(n)
    docs = small_batches(docs)
    if text_in is not None and dict(docs.dtypes).get(text_col) == "string":
        at = names.index(text_in)
        return docs.select(*keep), names, lambda batch: batch.column(at).field(text_col)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(unlike("text", [*names, *results])))
    return rows, names, lambda batch: batch.column(len(names))


def unlike(name: str, taken: list[str]) -> str:
    """name, with underscores until no taken name is the same in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def let(value: Column, then) -> Column:
    """then(value) with value evaluated once a row, also where then uses it inside another lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text as an array; null has none.

    One pass makes every character between words a blank and lower-cases A-Z; the split is by a
    plain character then.  Matching WORD gives the same at five times the cost.
    """
    blanked = F.translate(F.coalesce(text, F.lit("")), BETWEEN + UPPER, " " * len(BETWEEN) + UPPER.lower())
    return F.array_remove(F.split(blanked, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
