"""Substring deduplication: fixed blocks anchor repeats, which are then extended to all windows that repeat exactly.

A passage of WINDOW words that two documents share holds a whole aligned block of BLOCK words of either one, wherever it
begins (2 * BLOCK - 1 < WINDOW).  So each document's non-overlapping blocks are the index, and every rolling window
of BLOCK words probes it.  Equal blocks and windows have the same least gram, and windows side by side mostly share theirs: they
travel as one row (a run) under it, which is a tenth of the windows' own size.  From a window that met a block a hit is
extended as far as all windows' grams stand elsewhere too; there the WINDOW-word windows are compared by their text's
digest, and their union is the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linework.llm.common import BROADCAST_BYTES, checked_broadcast, join_hot, runs_of, small_batches
from linework.sources.scratch import save

#: Words of a passage that counts as a repeat, and of an anchor block.
WINDOW = 50
#: Words of the grams whose least one stands for a window.
GRAM = 9
#: The longest run of windows in one row.
MOST = 64
#: Odd constants of the rolling hash and its mixing (fixed values).
BASE, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _words(text: str | None) -> list[bytes]:
    """Words in UTF-8: bytes split at the six ASCII blanks."""
    return (text or "").encode().split()


def _grams(words: list[bytes], k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + h[i : len(h) - k + 1 + i]
    for shift, factor in zip((30, 27), MIX, strict=True):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(31))


def _least(grams: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        grams = np.minimum(grams[:-step], grams[step:])
        done += step
    return grams


def _runs(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of runs of equal values at consecutive places, of at most MOST; first indexes values."""
    cut = np.flatnonzero((values[1:] != values[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    first = np.concatenate([[0], cut])
    length = np.diff(np.append(first, len(values)))
    pieces = -(-length // MOST)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(first, pieces) + nth * MOST, np.minimum(np.repeat(length, pieces) - nth * MOST, MOST)


def _anchored(text: str | None, window: int, block: int):
    """(least gram, start, length, has_block) of the runs of a text's rolling block-word windows; None if it has no window."""
    words = _words(text)
    if len(words) < window:
        return None
    least = _least(_grams(words, GRAM), block - GRAM + 1)
    first, length = _runs(least, np.arange(len(least)))
    return least[first].view(np.int64), first, length, -(-first // block) * block < first + length


def _extended(text: str, spans: list[tuple[int, int]], window: int, block: int):
    """The windows of window words all of whose block-word windows begin inside one of spans, in runs of the same least gram:
    (least gram, digest of the run's text, start, length, digests of its windows)."""
    words = _words(text)
    at = np.concatenate([np.arange(a, b - (window - block)) for a, b in spans])
    least = _least(_grams(words, GRAM), window - GRAM + 1)[at]
    first, length = _runs(least, at)
    joined = b" ".join(words)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    digest, whole = xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest
    begin, end = starts[at].tolist(), (starts[at + window] - 1).tolist()
    own = [digest(joined[a:b]) for a, b in zip(begin, end, strict=True)]
    runs = [whole(joined[begin[a] : end[a + n - 1]]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
    return least[first].view(np.int64), np.array(runs, np.uint64).view(np.int64), at[first], length, np.array(own, np.uint64).view(np.int64)


def _list(values: list[np.ndarray], kind) -> pa.Array:
    """Arrays as a column of lists."""
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, kind)]).astype(kind)))


def _anchor_step(window: int, block: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop in runs_of(batch.column(2)):
                part = batch.slice(at, stop - at)
                found = [(n, r) for n, t in enumerate(part.column(2)) if (r := _anchored(t.as_py(), window, block))]
                keep = pa.array([n for n, _ in found], pa.int64())
                cols = [_list([r[i] for _, r in found], kind) for i, kind in enumerate((np.int64, np.int32, np.int32, np.bool_))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), *cols], ["id", "th", "gram", "start", "length", "block"])

    return step


def _extend_step(window: int, block: int):
    names = ["id", "th", "gram", "run", "start", "length", "windows"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop in runs_of(batch.column(2), size=1_000_000):
                part, rows, cols = batch.slice(at, stop - at), [], [[], [], [], [], []]
                for n, (text, spans) in enumerate(zip(part.column(2), part.column(3), strict=True)):
                    spans = sorted((s["start"], s["stop"]) for s in spans.as_py())
                    found = _extended(text.as_py(), spans, window, block)
                    rows += [n] * len(found[0])
                    for c, x in zip(cols, found, strict=True):
                        c.append(x)
                if rows:
                    rows = pa.array(rows, pa.int64())
                    *flat, windows = (np.concatenate(c) for c in cols)
                    ends = np.concatenate([[0], np.cumsum(flat[3])])
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    flat = [pa.array(x).cast(k) for x, k in zip(flat, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *flat, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(windows))], names)

    return step


def _cut_step(window: int, keep_text: bool):
    names = ["id", "n_words", "n_removed", "kept_sha256", "spans", "kept"][: 6 if keep_text else 5]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop in runs_of(batch.column(1)):
                part, rows = batch.slice(at, stop - at), []
                for text, spans in zip(part.column(1), part.column(2), strict=True):
                    words, merged = _words(text.as_py()), []
                    for a, b in sorted((s["start"], s["stop"]) for s in spans.as_py() or ()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                    kept, from_ = [], 0
                    for a, b in merged:
                        kept += words[from_:a]
                        from_ = b
                    kept = b" ".join(kept + words[from_:])
                    rows.append((len(words), sum(b - a for a, b in merged), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in merged], kept))
                n, gone, sha, spans, kept = zip(*rows, strict=True)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary()).cast(pa.string())] * keep_text, names)

    return step


def _schema(docs: DataFrame, rest: str) -> T.StructType:
    return T.StructType([T.StructField("id", docs.schema["id"].dataType), *T.StructType.fromDDL(rest).fields])


def _sized_broadcast(df: DataFrame, spans: str) -> DataFrame:
    """A broadcast hint on a saved table of keys and arrays of spans if its counted bytes fit."""
    size = df.agg(F.sum(64 + 16 * F.size(spans))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _join_key(rows: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """rows joined with facts of each (id, th); a null id meets none."""
    f = facts.withColumnsRenamed({"id": "f_id", "th": "f_th"})
    return rows.join(f, (rows["id"] == f["f_id"]) & (rows["th"] == f["f_th"]), how).drop("f_id", "f_th")


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, th, anchored) for those of docs(id, th, text) with hits: anchored are spans of places at each of which a
    window of a block's length begins whose least gram stands elsewhere too, at one of them as that of some document's block.

    Runs meet the counts of their grams by a join on the gram; one that very many runs have doesn't travel by its key.
    """
    block = window // 2
    schema = _schema(docs, "th long, gram array<long>, start array<int>, length array<int>, block array<boolean>")
    runs = save(docs.mapInArrow(_anchor_step(window, block), schema).withColumn("row", F.monotonically_increasing_id()), "repeat-anchors")
    each = lambda *c: F.explode(F.arrays_zip(*c)).alias("r")
    met = runs.select(each("gram", "block")).groupBy("r.gram").agg(F.count("*").alias("n"), F.bool_or("r.block").alias("indexed"))
    live = save(met.where("n > 1"), "repeat-grams")
    rows = join_hot(runs.select("row", each("gram", "start", "length")).select("row", "r.*"), live, "gram", live.agg(F.sum("n")).first()[0] or 0)
    span = F.struct(F.col("start"), (F.col("start") + F.col("length")).alias("stop"), "indexed")
    spans = rows.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("s")).select("row", "s", _merged("s").alias("anchored"))
    hit = lambda x: (x["stop"] - x["start"] > window - block) & F.exists("s", lambda r: r["indexed"] & (r["start"] >= x["start"]) & (r["stop"] <= x["stop"]))
    spans = spans.select("row", F.filter("anchored", hit).alias("anchored")).where(F.size("anchored") > 0)
    return spans.join(runs.select("row", "id", "th"), "row").dropDuplicates(["id", "th"]).select("id", "th", "anchored")


def _merged(spans: str) -> Column:
    """Spans sorted by both ends, those that touch or overlap as one."""
    s = F.col(spans)
    starts = F.transform(F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["stop"] < x["start"])), lambda x: x["start"])
    stops = F.transform(F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["start"] > x["stop"], F.lit(True))), lambda x: x["stop"])
    return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))


def repeats(docs: DataFrame, anchored: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, th, spans): the words of docs(id, th, text) that windows cover which also start in a document of a smaller id.

    Windows travel in runs of one least gram.  Runs with the same text are a class, counted once;
    where a gram has several classes, their windows are compared one by one.  So a passage of very many
    documents is a few classes, and no window of it meets all others.
    """
    block = window // 2
    around = _join_key(docs, _sized_broadcast(anchored, "anchored"), "inner").select("id", "th", "text", "anchored")
    runs = around.mapInArrow(_extend_step(window, block), _schema(docs, "th long, gram long, run long, start int, length int, windows array<long>"))
    runs = save(runs.select("id", "th", "start", "length", F.struct("gram", "run").alias("class"), "windows"), "repeat-runs")
    classes = runs.groupBy("class").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"), F.any_value("windows").alias("windows"))
    classes = save(classes.withColumn("no", F.monotonically_increasing_id()), "repeat-classes")
    several = classes.groupBy("class.gram").agg(F.count("*").alias("classes")).where("classes > 1").select("gram")
    loose = classes.select("no", "class.gram", "least", "windows").join(several, "gram", "left_semi").select("no", "gram", "least", F.posexplode("windows").alias("nth", "window"))
    first = loose.groupBy("gram", "window").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last").select("gram", "window", "first")
    earlier = loose.join(first, ["gram", "window"]).where("first < least").groupBy("no").agg(F.collect_list(F.struct("nth", "first")).alias("earlier"))
    facts = classes.drop("windows").join(earlier, "no", "left").where("earlier is not null or least < most")
    facts = save(facts.select("class", "least", "n", "earlier"), "repeat-facts")
    rows = join_hot(runs.select("id", "th", "start", "length", "class"), facts, "class", facts.agg(F.sum("n")).first()[0] or 0, 1024)
    span = lambda at, n: F.struct((F.col("start") + at).cast("int").alias("start"), (F.col("start") + at + n + window - 1).cast("int").alias("stop"))
    some = F.transform(F.filter("earlier", lambda w: w["first"] < F.col("id")), lambda w: span(w["nth"], F.lit(1)))
    gone = F.when(F.col("least") < F.col("id"), F.array(span(F.lit(0), F.col("length")))).otherwise(some)
    return rows.select("id", "th", F.explode(gone).alias("s")).groupBy("id", "th").agg(F.array_sort(F.collect_set("s")).alias("spans")).select("id", "th", _merged("spans").alias("spans"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, spans[, kept]) per row of docs.

    Removed is each word that a window of window words covers whose words also start, as they stand, in a
    document with a smaller id.  spans are the maximal runs of removed words, kept the other words
    joined by a blank (with keep_text), kept_sha256 its digest.  Windows are judged on the input.

    Texts are read three times and shuffled at most twice, and only where the spans of anchored or removed
    words are too many to broadcast.  Null texts have no words, texts of fewer words than a window none removed.
    Rows of one id don't remove each other's words, however often they stand; a row with a null id removes none and
    loses none.  An empty table gives no rows; other columns are ignored, so their names can't clash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    slim = small_batches(rows.select("id", F.xxhash64("text").alias("th"), "text"))
    known = slim.where("id is not null")
    gone = save(repeats(known, save(anchors(known, window), "repeat-spans"), window), "repeat-removed")
    cut = _join_key(slim, _sized_broadcast(gone, "spans"), "left").select("id", "text", "spans")
    schema = _schema(slim, "n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,stop:int>>" + ", kept string" * keep_text)
    return cut.mapInArrow(_cut_step(window, keep_text), schema).withColumnRenamed("id", id_col)
