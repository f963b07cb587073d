"""Cross-tokenizer alignment: which tokens of two tokenizers end together, and how often ids do.

Both token sequences of a text are merged by their cumulative byte ends, two pointers side by side: an offset where
both have an end closes a group and links the tokens that end there.  Neither tokenizer merges over a place
where a blank follows something else, so a text is a row of chunks that begin there: a worker remembers those it has met,
and encodes and merges a text's other chunks together.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linework.llm.common import checked_broadcast, join_hot, runs_of, small_batches
from linework.llm.packing import PATTERN, byte_of, ids_of, is_plain
from linework.sources.scratch import save

#: A chunk: from a blank that follows something else up to the next such.
_CHUNK = re.compile(r"(?<=\S)(?= )")
#: Chunks that a worker remembers, and the longest.
REMEMBERED, LONGEST = 1 << 17, 64
#: Chunks whose groups are written out together.
SHOWN = 10_000
#: The sign that stands for a blank in pieces, and pieces that stand for a byte (fixed values).
BLANK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass
class Side:
    """A tokenizer: encode gives the ids of a text, tokens the bytes of an id; chunked says whether chunks can be encoded apart."""

    encode: Callable[[str], list[int]]
    tokens: list[bytes]
    chunked: bool

    def __post_init__(self):
        self.sizes = list(map(len, self.tokens))
        self.shown = list(map(str, range(len(self.tokens))))

    def read(self, text: str, raw: bytes) -> tuple[list[int], list[int]] | None:
        """(ids, ends in bytes) of a text; None if their bytes aren't the text's."""
        ids = self.encode(text)
        return (ids, list(accumulate(map(self.sizes.__getitem__, ids)))) if b"".join(map(self.tokens.__getitem__, ids)) == raw else None


@lru_cache(maxsize=4)
def side(path: str) -> Side:
    """The tokenizer in path: byte-level BPE (.json or .tiktoken), which encodes a blank and the text, or a
    sentencepiece .model, which adds the blank itself.  Special tokens' strings are plain text."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        raw = [bytes([int(m[1], 16)]) if model.is_byte(i) and (m := _BYTE.fullmatch(p)) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        alone = model.piece_to_id(BLANK)  # a lone blank at the end: the model adds none to an empty text
        return Side(lambda text: model.encode(text[1:]) or [alone], raw, BLANK in pieces and not any(BLANK in p.lstrip(BLANK) for p in pieces))
    import tiktoken

    with open(path, "rb") as f:
        if path.endswith(".json"):
            held = json.load(f)
            special = {t["content"]: t["id"] for t in held["added_tokens"]}
            vocab = {t: i for t, i in held["model"]["vocab"].items()} | special
            tokens = [b""] * (max(vocab.values()) + 1)
            for t, i in vocab.items():
                tokens[i] = t.encode() if t in special else bytes(map(byte_of().__getitem__, t))
            if not is_plain(held):
                from tokenizers import Tokenizer

                known = Tokenizer.from_file(path)
                known.encode_special_tokens = True
                return Side(lambda text: known.encode(text, add_special_tokens=False).ids, tokens, False)
            ranks = {tokens[i]: i for t, i in held["model"]["vocab"].items() if t not in special}
        else:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            tokens = [b""] * (max(ranks.values()) + 1)
            for t, i in ranks.items():
                tokens[i] = t
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Side(lambda text: ids_of(text, encoding), tokens, True)


def merge(a_ends: list[int], b_ends: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups of two sorted lists of ends, as (first, stop) of each side: they close where both have the same end."""
    groups, i, j, a0, b0 = [], 0, 0, 0, 0
    last = max(a_ends[-1:] + b_ends[-1:], default=0) + 1
    a_ends, b_ends = [*a_ends, last], [*b_ends, last]  # where both pointers come to rest
    x, y = a_ends[0], b_ends[0]
    while x != last or y != last:
        if x < y:
            i += 1
            x = a_ends[i]
        elif y < x:
            j += 1
            y = b_ends[j]
        else:
            at = x
            while x == at:
                i += 1
                x = a_ends[i]
            while y == at:
                j += 1
                y = b_ends[j]
            groups.append((a0, i, b0, j))
            a0, b0 = i, j
    return groups


#: A pair of ids as a number.
PAIR = 1 << 32


#: A chunk aligned: its tokens on both sides, its groups and their text, and its links as pairs of ids.
Chunk = tuple[int, int, int, str, list[int]]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = side(a_path), side(b_path)
        self.chunked = self.a.chunked and self.b.chunked
        self.bare = 0 in self.a.sizes or 0 in self.b.sizes
        self.known: dict[str, Chunk] = {}

    def _align(self, chunks: list[str]) -> list[Chunk] | None:
        """Chunks that follow each other in some text, read and merged together and cut where each one ends."""
        text = "".join(chunks)
        raw = text.encode()
        left, right = self.a.read(text, raw), self.b.read(text, raw)
        if left is None or right is None:
            return None
        (a, a_ends), (b, b_ends) = left, right
        a_shown, b_shown = list(map(self.a.shown.__getitem__, a)), list(map(self.b.shown.__getitem__, b))
        out, shown, links, a_from, b_from = [], [], [], 0, 0
        ends = accumulate(len(c.encode()) for c in chunks)
        end = next(ends)
        for a0, a1, b0, b1 in merge(a_ends, b_ends):
            i, j = a1 - 1, b1 - 1
            shown.append(f"{a_shown[i] if i == a0 else ','.join(a_shown[a0:a1])}|{b_shown[j] if j == b0 else ','.join(b_shown[b0:b1])}")
            at = a_ends[i]
            if self.bare:  # tokens without bytes end where the one before does
                while i > a0 and a_ends[i - 1] == at:
                    i -= 1
                while j > b0 and b_ends[j - 1] == at:
                    j -= 1
                links += [x * PAIR + y for x in a[i:a1] for y in b[j:b1]]
            else:
                links.append(a[i] * PAIR + b[j])
            if at == end:
                out.append((a1 - a_from, b1 - b_from, len(shown), ";".join(shown), links))
                shown, links, a_from, b_from, end = [], [], a1, b1, next(ends, None)
        return out

    def text(self, text: str | None) -> list[Chunk] | None:
        """The chunks of a text aligned; None if it has no tokens: null, empty, or changed by a tokenizer."""
        if not text:
            return None
        text = " " + text
        if not self.chunked:
            return self._align([text])
        chunks = _CHUNK.split(text)
        found = list(map(self.known.get, chunks))
        if None in found:
            new = list(dict.fromkeys(c for c, x in zip(chunks, found, strict=True) if x is None))
            aligned = self._align(new)
            if aligned is None:
                return None
            fresh = dict(zip(new, aligned, strict=True))
            found = [x or fresh[c] for c, x in zip(chunks, found, strict=True)]
            if len(self.known) + len(fresh) > REMEMBERED:
                self.known.clear()
            self.known.update((c, x) for c, x in fresh.items() if len(c) <= LONGEST)
        return found


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _digests(a_path: str, b_path: str):
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "n"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path)
        for batch in batches:
            for at, stop in runs_of(batch.column(1), size=1_000_000):
                part, rows, pairs, times, ends = batch.slice(at, stop - at), [], [], [], [0]
                for text in part.column(1):
                    found = align.text(text.as_py())
                    if found is None:
                        rows.append((0, 0, 0, 0, ""))
                    else:
                        n_a, n_b, n_groups, shown, linked = zip(*found, strict=True)
                        links = Counter(chain.from_iterable(linked))
                        sha = hashlib.sha256()
                        for n in range(0, len(shown), SHOWN):
                            sha.update((";" * (n > 0) + ";".join(shown[n : n + SHOWN])).encode())
                        rows.append((sum(n_a), sum(n_b), sum(n_groups), links.total(), sha.hexdigest()))
                        pairs += links.keys()
                        times += links.values()
                    ends.append(len(pairs))
                *counts, sha = zip(*rows, strict=True)
                ends = pa.array(ends, pa.int32())
                cols = [*(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.ListArray.from_arrays(ends, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names)

    return step


def _groups(a_path: str, b_path: str):
    names = ["id", "nth", "start", "stop", "a_ids", "b_ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path)
        for batch in batches:
            for at, stop in runs_of(batch.column(1), size=250_000):
                part, rows = batch.slice(at, stop - at), []
                for n, text in enumerate(part.column(1)):
                    nth = place = 0
                    for x in align.text(text.as_py()) or ():
                        for group in x[3].split(";"):
                            a, b = (list(map(int, ids.split(","))) for ids in group.split("|"))
                            size = sum(map(align.a.sizes.__getitem__, a))
                            rows.append((n, nth, place, place + size, a, b))
                            nth, place = nth + 1, place + size
                if rows:
                    n, *cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(n)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return step


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))


def _schema(slim: DataFrame, rest: str) -> T.StructType:
    return T.StructType([T.StructField("id", slim.schema["id"].dataType), *T.StructType.fromDDL(rest).fields])


def groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, nth, start, stop, a_ids, b_ids): the groups of each text, with their bytes in a blank and the text."""
    slim = _slim(docs, id_col, text_col)
    return slim.mapInArrow(_groups(a_path, b_path), _schema(slim, "nth long, start long, stop long, a_ids array<int>, b_ids array<int>")).withColumnRenamed("id", id_col)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best_of_a, best_of_b, n) for each two ids that are linked in links(pair, n): how often, and whether
    that is the highest count of either id's pairs; n is the number of rows.  A side's ids are as many as its vocabulary has at most."""
    counts = save(links.groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("n")), "align-pairs")
    ids = {"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit(PAIR - 1))}
    out = counts
    for name, own in ids.items():
        most = counts.groupBy(own.alias(name)).agg(F.max("count").alias(f"most_{name}"))
        out = out.withColumn(name, own).join(most, name).withColumn(f"best_of_{name}", F.col("count") == F.col(f"most_{name}"))
    return out.select("pair", "count", "best_of_a", "best_of_b", "n")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a) per row of docs.

    n_best counts the links whose pair is the most frequent one of its b id over all documents (n_best_a: of its a id), count_sum
    adds up the pairs' counts over the links.  Each text's pairs are counted where it is encoded; what is
    joined back is a row for each pair of a text.  A pair in very many texts doesn't travel by its key (join_hot).

    Null and empty texts, and texts that a tokenizer changes, have no tokens: zeros and an empty digest.  Rows with
    the same id count each; an empty table gives no rows; other columns are ignored, so their names can't clash.
    """
    slim = _slim(docs, id_col, text_col)
    schema = _schema(slim, "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, n array<long>")
    rows = slim.mapInArrow(_digests(a_path, b_path), schema).withColumn("row", F.monotonically_increasing_id())
    rows = save(rows, "align-rows")
    links = rows.select("row", F.explode(F.arrays_zip("pair", "n")).alias("l")).select("row", "l.pair", "l.n")
    counts = save(pair_counts(links), "align-counts")
    held, total = counts.agg(F.count("*"), F.sum("n")).first()
    links = links.withColumnRenamed("n", "times")
    known = checked_broadcast(counts, 24, held)
    met = links.join(known, "pair") if known is not counts else join_hot(links, counts, "pair", total or 0)
    times = lambda c: F.sum(F.when(F.col(c), F.col("times")).otherwise(0))
    best = met.groupBy("row").agg(times("best_of_b").alias("n_best"), times("best_of_a").alias("n_best_a"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = rows.drop("pair", "n").join(best, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", zero("n_best_a"))
