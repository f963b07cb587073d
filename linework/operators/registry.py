"""Which chains a page keeps: each glyph serves once, each pair A X B stands once a page and axis."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linework.functions.geometry import rounded
from linework.functions.text import OPERATORS, reading_direction
from linework.operators.chains import KEYS, singleton_kind
from linework.operators.linking import fold_knots
from linework.sources.scratch import save, sized

#: Where the phases of a page's order begin; within a phase rows are numbered from 1, so phases never
#: meet: chains from 1 on, then leftover glyphs, formed pairs, merged references and fused digits.
AFTER, FORMED, MERGED, FUSED = (phase << 40 for phase in range(1, 5))


def _place(g, digits: int | None = None):
    """A glyph's identity: where it is (to a tenth, or exactly) and what it says."""
    at = [rounded(g[c], digits) if digits is not None else g[c] for c in ("cx", "cy")]
    return F.concat_ws("|", *(c.cast("string") for c in at), g["char"])


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Groups that share a place or a pair, page by page in processing order: kept, spent, skipped or burned."""
    status, page = [], None
    for r in rows.sort_values(["page_no", *ORDER, "nth"]).itertuples():
        if r.page_no != page:
            page, group, blocked = r.page_no, None, False
            used, taken, pairs = set(), set(), set()
        if r.node != group:
            group, blocked = r.node, not used.isdisjoint(r.group_exact) or not taken.isdisjoint(r.group_keys)
        if blocked or r.nth >= 0 and not (used.isdisjoint(r.exact) and taken.isdisjoint(r.keys)):
            status.append((page, r.node, r.nth, "skipped"))
        elif r.nth < 0:
            used.update(r.group_exact)
            status.append((page, r.node, r.nth, "burned"))
        elif r.pair is not None and r.pair in pairs:
            taken.update(r.keys)
            status.append((page, r.node, r.nth, "spent"))
        else:
            pairs.add(r.pair)
            used.update(r.exact)
            taken.update(r.keys)
            status.append((page, r.node, r.nth, "kept"))
    return pd.DataFrame(status, columns=["page_no", "first_seq", "nth", "status"]).astype({"page_no": "int64", "first_seq": "int64", "nth": "int32"})


def pair_key(axis, values):
    """The same for A X B and B X A on an axis."""
    a, b = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    return F.concat_ws("|", axis, F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


ORDER = ["axis_rank", "bucket_first", "component", "chunk", "piece"]


def ordered(groups: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """groups with their place in a page's processing order (ORDER); first_seq, their first glyph's, names them."""
    line = Window.partitionBy(*keys, "dimension_axis", "axis_bucket")
    return groups.withColumns({"axis_rank": F.when(F.col("dimension_axis") == "horizontal", 0).otherwise(1), "bucket_first": F.min("first_seq").over(line)})


def _shared(groups: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_seq, least) for the groups that share a glyph's place or a pair with others, or have one twice;
    least is the first group with it.  Only among those the order decides what is kept.

    Places and pairs are counted as hashes on the page; equal hashes of different ones put groups
    into order that needn't be, which changes nothing.
    """
    spots = F.transform("glyphs", lambda g: F.xxhash64(F.lit("place"), rounded(g["cx"], 1), rounded(g["cy"], 1), g["char"]))
    pairs = F.transform(F.filter("found", lambda d: d["entity_type"] == "SRC_dimension"), lambda d: F.xxhash64(F.lit("pair"), pair_key(F.col("dimension_axis"), d["values"])))
    marks = groups.select(*keys, "first_seq", F.explode(F.concat(spots, pairs)).alias("mark"))
    shared = sized(save(marks.groupBy(*keys, "mark").agg(F.count("*").alias("n"), F.min("first_seq").alias("least")).where("n > 1").drop("n"), "shared-marks"))
    return marks.join(shared, [*keys, "mark"]).select(*keys, "first_seq", "least").distinct()


def _settled(hard: DataFrame, shared: DataFrame, keys: list[str]) -> DataFrame:
    """The dimensions of groups that share something, with their status: one row each, and one for a group that found none."""
    dims = hard.select(*keys, "first_seq", "dimension_axis", "axis_bucket", *ORDER, "has_operator", "glyphs", F.posexplode_outer("found").alias("nth", "d"))
    dims = save(dims.withColumn("nth", F.coalesce("nth", F.lit(-1))).where((F.col("nth") >= 0) | F.col("has_operator")), "shared-dimensions")
    own = _own(F.col("glyphs"), F.coalesce("d.ids", F.array().cast("array<long>")))
    spots = lambda a, digits=None: F.transform(a, lambda g: _place(g, digits))
    pair = F.when(F.col("d.entity_type") == "SRC_dimension", pair_key(F.col("dimension_axis"), F.col("d.values")))
    ready = dims.select(*keys, F.col("first_seq").alias("node"), *ORDER, "nth", pair.alias("pair"), spots(F.col("glyphs"), 1).alias("group_keys"), spots(F.col("glyphs")).alias("group_exact"), spots(own, 1).alias("keys"), spots(own).alias("exact"))
    status = fold_knots(ready, shared.toDF(*keys, "u", "v"), keys, _settle, "first_seq long, nth int, status string")
    return save(dims.join(status, [*keys, "first_seq", "nth"]), "settled")


def _own(glyphs, ids):
    return F.filter(glyphs, lambda g: F.array_contains(ids, g["seq"]))


def chains(groups: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Kept chains in order, then each glyph that no chain used, as a chain of its own.

    groups is ordered().  Where no glyph or pair repeats, a group keeps all that it found, and its
    other glyphs are left over.  Only groups that share one need the order, and only those go through a fold.
    """
    shared = save(_shared(groups, keys), "shared")
    tied = sized(save(shared.select(*keys, "first_seq").distinct(), "tied"))
    plain, hard = (groups.join(tied, [*keys, "first_seq"], how) for how in ("left_anti", "left_semi"))
    dims = plain.select(*keys, "dimension_axis", "axis_bucket", *ORDER, "glyphs", F.posexplode("found").alias("nth", "d"))
    settled = _settled(hard, shared.hint("merge"), keys)
    kept = dims.unionByName(settled.where("status = 'kept'").select(*dims.columns))
    own = _own(F.col("glyphs"), F.col("d.ids"))
    over = lambda f, c: f(F.transform("own", lambda g: g[c]))
    named = ["grammar_fused", "grammar_rule", "nominal", "nominal_text", "tolerance_value", "entity_type", "operator", "values"]
    long = kept.withColumn("own", own).select(
        *keys, *ORDER, "nth", "dimension_axis", "axis_bucket", F.col("d.text").alias("text"), *(F.col(f"d.{n}").alias(n) for n in named),
        over(F.array_min, "x0").alias("x0"), over(F.array_min, "y0").alias("y0"), over(F.array_max, "x1").alias("x1"), over(F.array_max, "y1").alias("y1"), F.size("own").alias("glyph_count"), over(F.array_max, "h_near").alias("h_near"),
    )
    long = long.withColumn("chain_id", F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER, "nth"))).drop(*ORDER, "nth")
    long = long.withColumns({"orientation": F.when(F.col("glyph_count") > 1, F.col("dimension_axis")).otherwise(singleton_kind(F.col("dimension_axis"), F.col("h_near"))), "seq": F.col("chain_id").cast("long"), "direction_locked": F.lit(True)})

    used = F.flatten(F.transform("found", lambda d: d["ids"]))
    burned = F.col("has_operator") & (F.size("found") == 0)
    left = F.filter("glyphs", lambda g: ~burned & ~F.array_contains(F.col("used"), g["seq"]))
    glyph = ["seq", "char", "x0", "y0", "x1", "y1", "h_near"]
    one = lambda df, c: df.select(*keys, "dimension_axis", "axis_bucket", F.explode(c).alias("g"))
    rest = one(plain.withColumn("used", used), left)
    g = one(hard, F.col("glyphs")).withColumns({"key": _place(F.col("g"), 1), "exact": _place(F.col("g"))})
    spent = settled.where("status in ('kept', 'spent')").select(*keys, F.explode(F.transform(own, lambda g: _place(g, 1))).alias("key")).distinct()
    gone = settled.where("status = 'burned'").select(*keys, F.explode(F.transform("glyphs", lambda g: _place(g))).alias("exact")).distinct()
    g = g.join(spent, [*keys, "key"], "left_anti").join(gone, [*keys, "exact"], "left_anti")
    g = g.withColumn("again", F.row_number().over(Window.partitionBy(*keys, "key").orderBy("g.seq"))).where("again = 1").select(*rest.columns)
    rest = rest.unionByName(g).select(*keys, "dimension_axis", "axis_bucket", *(F.col(f"g.{n}").alias(n) for n in glyph)).where(~F.col("char").isin(*OPERATORS))
    null = lambda t: F.lit(None).cast(t)
    lone = rest.select(
        *keys, null("int").alias("chain_id"), "dimension_axis", "axis_bucket", F.col("char").alias("text"), F.lit(False).alias("grammar_fused"), null("string").alias("grammar_rule"), null("double").alias("nominal"), null("string").alias("nominal_text"),
        null("double").alias("tolerance_value"), null("string").alias("entity_type"), null("string").alias("operator"), null("array<double>").alias("values"), "x0", "y0", "x1", "y1", F.lit(1).alias("glyph_count"), "h_near",
        singleton_kind(F.col("dimension_axis"), F.col("h_near")).alias("orientation"), (F.row_number().over(Window.partitionBy(*keys).orderBy("seq")) + F.lit(AFTER)).cast("long").alias("seq"), null("boolean").alias("direction_locked"),
    )
    return long.unionByName(lone).drop("h_near").withColumn("reading_direction", reading_direction(F.col("dimension_axis")))
