"""Packing token sequences by minimum bin slack over the histogram of piece lengths."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linework.llm.common import checked_broadcast, runs_of, small_batches
from linework.sources.scratch import save

CAPACITY = 1024
#: The word pattern of the tokenizer's published description (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blanks in a row that are cut out before the pattern is tried.
LONG_BLANK = 10_000
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_BLANK)
#: Ranks within a length are counted in parts of about this many pieces, so that one length may hold most of them.
PART_PIECES = 1_000_000


def is_plain(held: dict) -> bool:
    """Whether a tokenizer's .json is byte-level BPE with the published word pattern and nothing else that changes a text."""
    cut, model = held.get("pre_tokenizer") or {}, held["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True) and not held.get("normalizer")
    marks = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in held["added_tokens"])
    return bool(plain and marks and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges"))


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """A function from a text to its ids by the tokenizer in path: a .json, or a .tiktoken file of ranks.

    The ids are those that the tokenizers library gives without adding special tokens.  For plain byte-level
    BPE another library finds them some eight times as fast; any other .json goes to tokenizers itself.
    """
    import tiktoken

    with open(path, "rb") as f:
        if path.endswith(".json"):
            held = json.load(f)
            if not is_plain(held):
                from tokenizers import Tokenizer

                known = Tokenizer.from_file(path)
                return lambda text: known.encode(text, add_special_tokens=False).ids
            special = {t["content"]: t["id"] for t in held["added_tokens"]}
            ranks = {bytes(map(byte_of().__getitem__, t)): i for t, i in held["model"]["vocab"].items() if t not in special}
        else:
            special, ranks = {}, {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: ids_of(text, encoding)


@lru_cache
def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for
    themselves, the rest in order from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}


def ids_of(text: str, encoding) -> list[int]:
    """The ids of a text.  Runs of blanks too long for the pattern's backtracking are pieces of
    their own here, cut as the pattern cuts them: all but a last blank that something follows."""
    ids, at = [], 0
    if len(text) > LONG_BLANK:
        for m in _BLANKS.finditer(text):
            end = m.end()
            if end < len(text) and not text.startswith(tuple(encoding.special_tokens_set), end):
                end -= 1
            ids += encoding.encode(text[at : m.start()], allowed_special="all") + encoding.encode(text[m.start() : end])
            at = end
    return ids + encoding.encode(text[at:], allowed_special="all")


def _cutter(path: str, capacity: int, end_id: int, names: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at, stop in runs_of(batch.column(1)):
                part, rows = batch.slice(at, stop - at), []
                for n, text in enumerate(part.column(1)):
                    ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                    rows += [(n, s, len(x := ids[s : s + capacity]), zlib.crc32(x.tobytes()), len(ids)) for s in range(0, len(ids), capacity)]
                n, *cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(n)), *(pa.array(c, pa.int64()) for c in cols)], names)

    return cut


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Each document's ids with end_id after them, cut every capacity ids: id, start, length, ids_crc32, doc_tokens.

    A null text counts as empty and gives a piece of end_id alone.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = T.StructType([T.StructField("id", slim.schema["id"].dataType), *(T.StructField(n, T.LongType()) for n in names[1:])])
    return small_batches(slim).mapInArrow(_cutter(path, capacity, end_id, names), schema)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum comes closest to room from below.

    Subset sums are the bits of an integer; one integer a length is kept for the way back.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        steps.append((length, reach))
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            reach |= (reach << (part * length)) & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> at & 1:
            at -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, first_rank, n, per_sequence, first_sequence, offset, sequence_tokens).

    Each sequence takes the longest remaining length and the multiset that leaves least slack
    beside it; the same filling repeats while the counts last.  So there are about as many
    fillings as lengths, however many pieces there are.
    """
    left, rank, rows, sequence = {k: v for k, v in histogram.items() if v}, dict.fromkeys(histogram, 0), [], 0
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        chosen = fill({k: v for k, v in rest.items() if v}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times, offset, tokens = min(left[k] // n for k, n in chosen.items()), 0, sum(k * n for k, n in chosen.items())
        for length, n in sorted(chosen.items(), reverse=True):
            rows.append((length, rank[length], times * n, n, sequence, offset, tokens))
            rank[length] += times * n
            offset += length * n
            left[length] -= times * n
            if not left[length]:
                del left[length]
        sequence += times
    return rows


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """All documents packed into sequences of at most capacity ids, one row for each piece.

    Columns: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_to.  Text is
    tokenized once; what follows works on numbers.  The driver gets the histogram of lengths (at
    most capacity rows) and returns the plan; a piece's rank among those of its length gives its
    place.  Ranks are counted in parts of PART_PIECES a length, so one length may hold any share of
    the rows.  padded_to is capacity, or the sequence's own size where that is a power of two.
    Null texts give one id; repeated rows are packed each; an empty table gives no rows; other
    columns are ignored, so their names can't clash.
    """
    spark = docs.sparkSession
    cut = save(pieces(docs, path, id_col, text_col, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts = spark.createDataFrame([(k, -(-n // PART_PIECES)) for k, n in histogram.items()], "length long, parts long")
    cut = cut.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("row"), "parts")).drop("parts")  # capacity rows at most
    counted = save(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "start", "ids_crc32", "row"))
    ranked = cut.withColumn("nth", within).join(checked_broadcast(offsets, 24, counted.count()), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("earlier") + F.col("nth") - 1)
    schema = "length long, first_rank long, n long, per_sequence long, first_sequence long, first_offset long, tokens long"
    table = spark.createDataFrame(plan(histogram, capacity), schema)
    r = F.col("rank") - F.col("first_rank")
    placed = ranked.join(F.broadcast(table), ["length"]).where((r >= 0) & (r < F.col("n")))
    turn = F.floor(r / F.col("per_sequence")).cast("long")
    power = F.bit_count("tokens") == 1
    return placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + turn).alias("sequence_id"),
        (F.col("first_offset") + (r - turn * F.col("per_sequence")) * F.col("length")).alias("offset"),
        F.when(power, F.col("tokens")).otherwise(F.lit(capacity)).cast("long").alias("padded_to"),
    )
