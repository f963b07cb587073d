"""Source divergence audit: how far the term shares of a language's sources lie apart, exactly.

The distance of two sources is a sum over all terms of their language, most of which at least one of them lacks.
Inclusion and exclusion over supports keeps the work to the terms that are there: a histogram of each source's counts
prices its terms as if the other lacked them all, a join of postings corrects the terms that both have, and terms that
both lack cost a constant each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.llm.common import checked_broadcast, runs_of, small_batches
from linework.sources.scratch import save

#: A language keeps the terms of at least so many documents.
LEAST_DOCS = 30
#: Shares are whole parts of SCALE, counts smoothed by SMOOTH (fixed values of the contract).
SCALE, SMOOTH = 1_000_000_000, 5
#: Terms listed for a source.
TOP_TERMS = 50
#: Terms that a task counts before it hands on what it has.
HELD = 200_000
#: Sources of a term that meet all others in one task; the terms of more go to more tasks.
PART_SOURCES = 1024
#: A term in lower-cased UTF-8: letters and everything outside ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences and documents of each term in what a task has read so far, and for
    each source a row without a term."""
    seen: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def hand_on() -> pa.RecordBatch:
        rows = [(*k, t, n, docs[k][t]) for k, found in seen.items() for t, n in found.items()] + [(*k, None, 0, 0) for k in seen]
        lang, source, term, n, d = zip(*rows, strict=True)
        seen.clear(), docs.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for at, stop in runs_of(batch.column(2)):
            for lang, source, text in zip(*(c.slice(at, stop - at).to_pylist() for c in batch.columns), strict=True):
                found = Counter(_TERM.findall(text.encode().lower()))
                key = (lang, source)
                seen.setdefault(key, Counter()).update(found)
                docs.setdefault(key, Counter()).update(found.keys())
            if sum(map(len, seen.values())) > HELD:
                yield hand_on()
    if seen:
        yield hand_on()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): how often and in how many documents each source of each language has each term.
    Each source also has a row whose term is null, so those without terms are known."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = small_batches(docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")))
    found = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)) without rounding at any size; null where there are no terms."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    part = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + SMOOTH, 20), (whole(total, 20) + SMOOTH * whole(terms, 20)).cast("decimal(31,0)"))
    return F.when(terms > 0, part + 1)


def shares(counts: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, postings) of term_counts().

    groups: lang, source, n_terms (kept terms of the language), support (those that the source has), zero (the share of a
    term that it lacks).  postings: lang, source, term, share, lang_share, zero, sources (how many have the term).
    """
    counts = save(counts, "audit-counts")
    had = counts.where("term is not null")
    kept = had.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.count("*").alias("sources")).where(F.col("docs") >= least_docs).drop("docs")
    kept = save(kept, "audit-terms")
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    posts = save(had.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "audit-postings")
    totals = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left").select("lang", "source", zero("total"), zero("support"), zero("n_terms"), zero("lang_total"))
    groups = save(groups.withColumn("zero", F.coalesce(_share(F.lit(0), F.col("total"), F.col("n_terms")), F.lit(0))), "audit-groups")
    posts = posts.join(checked_broadcast(groups, 128), ["lang", "source"])
    posts = posts.select("lang", "source", "term", "sources", "zero", _share(F.col("n"), F.col("total"), F.col("n_terms")).alias("share"), _share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms")).alias("lang_share"))
    return groups.select("lang", "source", "n_terms", "support", "zero"), save(posts, "audit-shares")


def _dealt(rows: DataFrame, others: DataFrame, parts: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with a part: a row goes to one by its source, one of others to all, so that a hot key has many tasks."""
    return rows.withColumn("part", F.pmod(F.xxhash64("source"), parts)), others.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))


def _both_ways(rows: DataFrame) -> DataFrame:
    return rows.select("lang", "source", "item", "value").union(rows.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def distances(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways: the sum over the language's terms of
    the difference of their shares.

    A row a pair is what is asked for; the joins that give them are dealt by source, so no language or term
    is one task's.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), F.col("support").alias("item_support"))
    n = groups.count()
    parts = F.lit(-(-n // PART_SOURCES)).cast("long")

    def meet(rows: DataFrame) -> DataFrame:
        a, b = _dealt(rows, other, parts)
        return a.join(checked_broadcast(b, 128, n * -(-n // PART_SOURCES)), ["lang", "part"]).where("source <> item")

    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    lacking = meet(groups).select("lang", "source", "item", ((F.col("n_terms") - F.col("support") - F.col("item_support")) * gap("zero", "item_zero")).alias("value"))
    histogram = save(postings.groupBy("lang", "source", "share").agg(F.count("*").alias("terms")), "audit-histograms")
    one_sided = meet(histogram).groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * gap("share", "item_zero")).alias("value"))
    several = postings.where("sources > 1").withColumn("parts", F.ceil(F.col("sources") / PART_SOURCES))
    a, b = _dealt(several, several.select("lang", "term", "parts", F.col("source").alias("item"), F.col("share").alias("item_share"), F.col("zero").alias("item_zero")), F.col("parts"))
    shared = a.join(b.drop("parts"), ["lang", "term", "part"]).where("source < item")
    correction = gap("share", "item_share") - gap("share", "item_zero") - gap("item_share", "zero") + gap("zero", "item_zero")
    shared = shared.groupBy("lang", "source", "item").agg(F.sum(correction).alias("value"))
    return lacking.union(_both_ways(one_sided)).union(_both_ways(shared)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others, and by what.

    part 'pair': item is another source of the language, value their distance.  part 'term': item is a term that the source
    has in a larger share than its language, value by how much; the first top of them.  rank counts from 1, largest value
    first, then by item.

    Null texts, languages and sources count as empty ones.  Sources without terms have pairs; a language
    without kept terms gives value 0; a lone source has none.  Repeated rows count each; an empty table gives no
    rows; other columns are ignored, so their names can't clash.
    """
    groups, postings = shares(term_counts(docs, text_col, lang_col, source_col), least_docs)
    pairs = distances(groups, postings).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = postings.where("share > lang_share").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("lang_share")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).union(terms)


#: The definition in DuckDB: every kept term for every group.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::hugeint AS ln FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
ls AS (SELECT lang, count(*)::hugeint AS v, sum(ln)::hugeint AS total FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*)::hugeint AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
gt AS (SELECT lang, source, sum(n)::hugeint AS total FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(gt.total, 0) + 5 * ls.v) AS p, 1 + (1000000000::hugeint * (k.ln + 5)) // (ls.total + 5 * ls.v) AS q
  FROM g JOIN kept k USING (lang) JOIN ls USING (lang) LEFT JOIN gt USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value::bigint AS value, rank::int AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
