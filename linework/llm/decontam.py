"""Benchmark decontamination by winnowing, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.common import PREFIX_BITS, checked_broadcast, in_bitmap, join_skewed, let, prefix_bitmap, word_count, words
from linework.sources.scratch import save

#: Words of a window; an item of fewer words is one window.
SPAN = 13
#: A document is contaminated if it has a hit and at least one word in this many is hit.
SHARE = 20
#: A place in a text has this many values.
PLACES = 1 << 31


def parameters(span: int) -> tuple[int, int]:
    """(k, w): words of a gram and grams of a window so that each shared span of span words shares
    a fingerprint: w + k - 1 = span."""
    k = max(1, (span + 1) // 2 - (span > 12))
    return k, span - k + 1


def _placed_grams(tokens: Column, k: int) -> Column:
    """A number for each k consecutive words: 31 bits of their hash, then 31 of their place (from 0).

    So the least number has the least hash, and its place with it; none if there are fewer words.
    """
    none = F.array().cast("array<long>")
    hashed = lambda t, i: F.shiftrightunsigned(F.xxhash64(F.slice(t, i + 1, k)), 33)
    each = lambda t: F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(0), F.size(t) - k), lambda i: hashed(t, i) * PLACES + i)).otherwise(none)
    return let(tokens, each)


def _least_with(by: int):
    """A function that gives, at each place of an array, the lesser of its value and that by places on."""

    def least(a: Column) -> Column:
        return F.zip_with(a, F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0))), lambda x, y: F.least(x, y))

    return least


def winnow(grams: Column, w: int) -> Column:
    """The distinct minima of each w consecutive placed grams.

    Minima of 2, 4, 8... are minima of two earlier ones.  Windows that run past the end hold what
    is left, so short texts have fingerprints too.
    """
    done = 1
    while done < w:
        step = min(done, w - done)
        grams = let(grams, _least_with(step))
        done += step
    return F.array_distinct(grams)


def _marks(tokens: Column, span: int, known: Column | None) -> Column:
    """An array of struct(span, fp, from, around): the winnowed grams of words, each with the words
    that a window of span words over it can have, and where they begin.  known: a bitmap of the
    prefixes of those that can join."""
    k, w = parameters(span)

    def mark(x: Column) -> Column:
        at = F.pmod(x, F.lit(PLACES)).cast("int")
        start = F.greatest(at - (w - 1), F.lit(0))
        return F.struct(F.lit(span).alias("span"), F.shiftrightunsigned(x, 31).alias("fp"), start.alias("from"), F.slice(tokens, start + 1, at + span - start).alias("around"))

    found = winnow(_placed_grams(tokens, k), w)
    if known is not None:
        found = F.filter(found, lambda x: in_bitmap(F.shiftrightunsigned(x, 31 + 31 - PREFIX_BITS), known))
    return F.transform(found, mark)


def fingerprints(texts: DataFrame, spans: list[int], keys: list[str], known: Column | None = None) -> DataFrame:
    """keys, span, fp, from and around for each winnowed gram of the texts' words, for every span."""
    marks = let(F.col("words"), lambda t: F.concat(*(_marks(t, s, known) for s in spans)))
    return texts.select(*keys, F.explode(marks).alias("m")).select(*keys, "m.*")


def _windows_in(words_of: Column, span: Column) -> Column:
    """An array of struct(start, window): every window of span words, as text."""
    starts = F.when(F.size(words_of) >= span, F.sequence(F.lit(0), F.size(words_of) - span)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.array_join(F.slice(words_of, i + 1, span), " ").alias("window")))


def _covered(spans: Column) -> Column:
    """Words in the union of (start, stop) spans that are sorted by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))
    add = lambda a, s: F.struct(
        F.greatest(a["end"], s["stop"]).alias("end"),
        (a["words"] + F.greatest(s["stop"] - F.greatest(a["end"], s["start"]), F.lit(0))).cast("long").alias("words"),
    )
    return F.aggregate(spans, zero, add, lambda a: a["words"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated, text_hash) per row of docs.

    One pass tokenises each document and winnows it for every length of item windows there is: SPAN
    words, and fewer where items are shorter.  Winnowed grams carry the words around them to a
    broadcast of the items' (a shuffle if that is too large), so a document's text is read once
    and never shuffled; a passage that very many documents have stays where it is even then (join_skewed).
    Grams whose hash prefix no item has are left out by a bitmap before.  Around each shared gram the exact windows are compared as text, so no
    hash decides a hit.

    Null texts have no words and no hits.  Items without words are left out; one with a null id
    counts for n_hit, and its id is in no list.  Rows with the same id and text get the same result
    each; an empty benchmark contaminates nothing; columns besides the named ones are ignored, so
    their names can't clash.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words(F.col(item_text_col).cast("string")).alias("words")).where(F.size("words") > 0)
    items = save(items.withColumn("span", F.least(F.size("words"), F.lit(SPAN))), "benchmark-items")
    spans = sorted(r["span"] for r in items.select("span").distinct().collect())
    counted = docs.select("id", "th", word_count(F.col("text")).alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    if not spans:
        out = counted.select("id", "th", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"))
    else:
        known = fingerprints(items, spans, ["span"]).toDF("own", "span", "fp", "from", "around").where("own = span")
        known = save(known.select("span", "fp").distinct(), "benchmark-fingerprints")
        held = items.select("item_id", F.explode(_windows_in(F.col("words"), F.col("span"))).alias("w")).select("item_id", "w.window").distinct()
        held = save(held, "benchmark-windows")
        tokens = docs.select("id", "th", words(F.col("text")).alias("words"))
        bitmap = prefix_bitmap(r[0] for r in known.select(F.shiftrightunsigned("fp", 31 - PREFIX_BITS)).distinct().collect())
        met = join_skewed(fingerprints(tokens, spans, ["id", "th"], bitmap), known, ["span", "fp"], 16 * known.count())
        tried = met.select("id", "th", "span", "from", F.explode(_windows_in(F.col("around"), F.col("span"))).alias("w")).select("id", "th", "span", (F.col("from") + F.col("w.start")).alias("start"), "w.window")
        windows = save(held.select("window").distinct(), "benchmark-window-texts")
        size = windows.agg(F.count("*"), F.sum(F.octet_length("window"))).first()
        hits = save(join_skewed(tried, windows, ["window"], 64 * size[0] + (size[1] or 0)).select("id", "th", "start", (F.col("start") + F.col("span")).alias("stop"), "window").distinct(), "benchmark-hits")
        covered = hits.groupBy("id", "th").agg(_covered(F.array_sort(F.collect_list(F.struct("start", "stop")))).alias("n_hit"))
        items_of = held.where("item_id is not null")
        listed = join_skewed(hits.select("id", "th", "window").distinct(), items_of, ["window"], items_of.agg(F.sum(F.octet_length("window") + F.octet_length("item_id") + 64)).first()[0] or 0).select("id", "th", "item_id").distinct()
        listed = listed.groupBy("id", "th").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item_id"))), 256).alias("items_sha256"))
        same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])
        per_doc = covered.join(listed, same(covered, listed), "left").select(covered["id"].alias("hid"), covered["th"].alias("hth"), "n_hit", "n_items", "items_sha256")
        per_doc = checked_broadcast(save(per_doc, "benchmark-counts"), 128)
        joined = counted.join(per_doc, counted["id"].eqNullSafe(per_doc["hid"]) & (counted["th"] == per_doc["hth"]), "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        out = joined.select("id", "th", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"))
    bad = (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", bad.alias("contaminated"), F.col("th").alias("text_hash"))


#: The contract's rule in DuckDB: all windows of all items against all windows of the documents.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 13) AS span FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, span, array_to_string(w[s : s + span - 1], ' ') AS win FROM (SELECT item_id, w, span, unnest(range(1, len(w) - span + 2)) AS s FROM bs)),
dw AS (SELECT doc_id, s, x.span, array_to_string(w[s : s + x.span - 1], ' ') AS win
  FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS s FROM d, (SELECT DISTINCT span FROM bs)) x),
hit AS (SELECT doc_id, s, dw.span, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.span = bw.span),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + span)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, coalesce(h, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""
