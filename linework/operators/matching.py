"""Operators that bind annotations to each other: pairs, tolerances, thickness, references, stacked digits.

Where the result depends on the order of matches, the candidates are found with joins and windows
and only the matches of one page, in order, go through a fold.

Tables that grow with the pages ask for merge joins: Spark takes the size of their compressed files for theirs, and
would broadcast millions of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.functions import text as tx
from linework.functions.geometry import Box, mm, rounded
from linework.operators.chains import KEYS
from linework.operators.linking import fold_knots, fold_pages
from linework.operators.registry import FORMED, FUSED, MERGED, pair_key
from linework.operators.spatial import within
from linework.sources.scratch import save, sized

# Fixed values of the drawing rules.
ANCHOR_MM, PAIR_GAP_MM, THICKNESS_MM = 2.0, 6.0, 2.0
REFERENCE_REACH, TOLERANCE_REACH, LINE = 40.0, 60.0, 12.0
#: How much farther a tolerance may stand from its number on a vertical line.
UPRIGHT = 1.5


def form_pairs(cands: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Neighbouring bare numbers on one line with room for an X between them become 'A X B'.

    Pairs form from the start of each line on; a number serves once and a page's axis has each pair
    once, counting those that the chains have.  What remains keeps its order, formed pairs follow.
    """
    axis, up = F.col("dimension_axis"), F.col("dimension_axis") == "vertical"
    number = cands.where((F.coalesce("entity_type", F.lit("")) != "SRC_dimension") & F.col("text").rlike(r"^\d+(\.\d+)?$") & (F.length("text") <= 6))
    line = [*keys, "dimension_axis", "axis_bucket"]
    w = Window.partitionBy(*line).orderBy(F.when(up, -F.col("cy")).otherwise(F.col("cx")), "seq")
    own = F.struct(*("seq", "text", "cx", "cy", "x0", "y0", "x1", "y1", "glyph_count", "orientation"))
    all_of = Window.partitionBy(*line)
    p = number.withColumns({"a": own, "b": F.lead(own).over(w), "nth": F.row_number().over(w), "line_first": F.min("seq").over(all_of), "on_line": F.count("*").over(all_of)}).where("on_line >= 2")
    gap = F.when(up, F.col("a.y0") - F.col("b.y1")).otherwise(F.col("b.x0") - F.col("a.x1"))
    offset = F.when(up, F.abs(F.col("a.cx") - F.col("b.cx"))).otherwise(F.abs(F.col("a.cy") - F.col("b.cy")))
    room = F.greatest(F.col("a.x1") - F.col("a.x0"), F.col("b.x1") - F.col("b.x0"), F.lit(1.0)) * 0.35
    p = p.withColumns({"gap": gap, "offset": offset, "left": tx.to_double(F.col("a.text")), "right": tx.to_double(F.col("b.text"))}).withColumn("right_text", tx.plain_number(F.col("right")))
    fits = F.col("b").isNotNull() & (F.col("offset") <= mm(ANCHOR_MM)) & (F.col("gap") > 0) & (F.col("gap") <= mm(PAIR_GAP_MM)) & (F.col("gap") >= room)
    fits &= tx.pair_may_form(F.col("left"), F.col("right"), F.col("right_text"), F.lit(""), F.col("a.orientation"))
    # judged below the window, so the filter above it reads one column and repeats nothing
    p = p.withColumn("fits", fits).withColumn("zone", F.dense_rank().over(Window.partitionBy(*keys).orderBy("line_first"))).where("fits").drop("fits", "offset", "right_text")
    mark = lambda s: F.concat_ws("|", rounded(F.col(f"{s}.cx"), 1).cast("string"), rounded(F.col(f"{s}.cy"), 1).cast("string"), F.col(f"{s}.text"))
    p = p.withColumns({"ka": mark("a"), "kb": mark("b"), "pair": pair_key(axis, F.array("left", "right"))})
    known = cands.where("entity_type = 'SRC_dimension'").select(*keys, pair_key(axis, F.col("values")).alias("pair")).distinct().hint("merge")
    formed = _chosen(p.join(known, [*keys, "pair"], "left_anti"), keys)
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("line_first", "nth"))
    formed = save(formed.withColumn("order", order), "formed")
    box = Box.of("a.").merged(Box.of("b."))
    x, y = box.center()
    out = formed.select(
        *keys, (F.col("order") + F.lit(FORMED)).cast("long").alias("seq"), F.concat(tx.short_number(F.col("left")), F.lit(" X "), tx.short_number(F.col("right"))).alias("text"),
        *(c.alias(n) for n, c in box.columns().items()), x.alias("cx"), y.alias("cy"), (F.col("a.glyph_count") + F.col("b.glyph_count")).alias("glyph_count"),
        F.col("a.orientation").alias("orientation"), "dimension_axis", "axis_bucket", tx.reading_direction(axis).alias("reading_direction"), F.lit(True).alias("direction_locked"), F.lit(True).alias("grammar_fused"),
        F.lit("LOCAL_ANCHOR_PAIR").alias("grammar_rule"), F.lit("SRC_dimension").alias("entity_type"), F.lit("X").alias("operator"), F.array("left", "right").alias("values"), F.col("zone").alias("semantic_zone_id"),
        x.alias("anchor_x"), y.alias("anchor_y"), F.lit(ANCHOR_MM).alias("anchor_radius_mm"), F.lit(True).alias("reconstructed_operator"), tx.pair_confidence(F.col("gap"), mm(PAIR_GAP_MM)).alias("confidence"),
    )
    gone = sized(save(formed.select(*keys, F.explode(F.array("a.seq", "b.seq")).alias("seq")), "gone"))
    return cands.join(gone, [*keys, "seq"], "left_anti").unionByName(out, allowMissingColumns=True)


def _take_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """A page's pairs in order: each is taken whose numbers and whose pair are still free."""
    taken, page = [], None
    for r in rows.sort_values(["page_no", "line_first", "nth"]).itertuples():
        if r.page_no != page:
            page, used, pairs = r.page_no, set(), set()
        if r.ka not in used and r.kb not in used and r.pair not in pairs:
            used.update((r.ka, r.kb))
            pairs.add(r.pair)
            taken.append((page, r.line_first, r.nth))
    return pd.DataFrame(taken, columns=["page_no", "line_first", "nth"]).astype({"page_no": "int64", "line_first": "int64", "nth": "int32"})


def _chosen(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of pairs (neighbours a, b at place nth of their line, none of a known pair) that form.

    Pairs that follow each other on a line share a number: of such an island every second one forms, from the
    first on.  Where a pair or a number's place stands more than once on the page, an earlier one may stop a
    later one, so islands with such a pair or place go through a fold.
    """
    line = Window.partitionBy(*keys, "line_first").orderBy("nth")
    island = Window.partitionBy(*keys, "line_first", "run")
    p = pairs.withColumn("run", F.col("nth") - F.row_number().over(line))
    p = save(p.withColumns({"place": F.col("nth") - F.min("nth").over(island), "node": F.min_by("a.seq", "nth").over(island)}), "neighbours")
    twice = lambda marks: marks.groupBy(*keys, "mark").agg(F.count_distinct("id").alias("n"), F.min("node").alias("least")).where("n > 1").drop("n")
    marks = p.select(*keys, "node", F.explode(F.array(F.struct(F.concat(F.lit("p"), "pair").alias("mark"), F.col("a.seq").alias("id")), F.struct(F.concat(F.lit("n"), "ka").alias("mark"), F.col("a.seq").alias("id")), F.struct(F.concat(F.lit("n"), "kb").alias("mark"), F.col("b.seq").alias("id")))).alias("m")).select(*keys, "node", "m.*")
    shared = save(marks.join(twice(marks), [*keys, "mark"]).select(*keys, F.col("node").alias("u"), F.col("least").alias("v")).distinct(), "shared").hint("merge")
    tied = shared.select(*keys, F.col("u").alias("node")).distinct()
    plain = p.join(tied, [*keys, "node"], "left_anti").where("place % 2 = 0")
    rows = save(p.join(tied, [*keys, "node"], "left_semi").select(*keys, "node", "line_first", "nth", "ka", "kb", "pair"), "shared-pairs")
    taken = fold_knots(rows, shared, keys, _take_pairs, "line_first long, nth int")
    return plain.unionByName(p.join(taken, [*keys, "line_first", "nth"], "left_semi"))


def _take_nearest(rows: pd.DataFrame) -> pd.DataFrame:
    """A page's lefts in order: each takes its nearest right that is still free."""
    taken, page = [], None
    for r in rows.sort_values(["page_no", "l", "d", "r"]).itertuples():
        if r.page_no != page:
            page, lefts, rights = r.page_no, set(), set()
        if r.l not in lefts and r.r not in rights:
            lefts.add(r.l)
            rights.add(r.r)
            taken.append((page, r.l, r.r))
    return pd.DataFrame(taken, columns=["page_no", "l", "r"]).astype("int64")


def _greedy(pairs: DataFrame, keys: list[str], left: str, right: str, gap: str) -> DataFrame:
    """One-to-one matches: each left in order takes its nearest right that is still free (then by seq).

    Two that have nobody else match at once; only the others go through a fold.
    """
    only = lambda c: F.count("*").over(Window.partitionBy(*keys, c)) == 1
    p = pairs.select(*keys, F.col(left).alias("l"), F.col(right).alias("r"), F.col(gap).alias("d")).withColumns({"one": only("l"), "other": only("r")})
    p = save(p.select(*keys, F.col("l").alias("node"), "l", "r", "d", (F.col("one") & F.col("other")).alias("sure")), "matches")
    rest = p.where("not sure").drop("sure")
    met = fold_knots(rest, rest.select(*keys, F.col("l").alias("u"), F.col("r").alias("v")), keys, _take_nearest, "l long, r long")
    return p.where("sure").select(*keys, "l", "r").union(met).toDF(*keys, left, right).hint("merge")


def nearest_parent(modifiers: DataFrame, entities: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, mseq, seq): for each tolerance modifier the nearest number on its line that it fits.

    modifiers have seq, text, box, centre, orientation, dimension_axis.  A modifier stands to the
    right of its number, or above it on a vertical line.
    """
    m = modifiers.select(*keys, F.col("seq").alias("mseq"), tx.parse_tolerance(F.col("text")).alias("value"), F.col("cx").alias("mx"), F.col("cy").alias("my"), F.col("orientation").alias("mo"), F.col("dimension_axis").alias("ma")).where("value is not null")
    numbers = entities.where("nominal is not null").select(*keys, "seq", "nominal", "cx", "cy", "orientation", "dimension_axis")
    both = within(m, numbers, keys, TOLERANCE_REACH * UPRIGHT, ("mx", "my"), ("cx", "cy"))
    dx, dy = F.col("mx") - F.col("cx"), F.col("cy") - F.col("my")
    up = F.col("dimension_axis") == "vertical"
    placed = F.when(up, (F.abs(dx) <= LINE) & (dy >= 0)).otherwise((F.abs(dy) <= LINE) & (F.col("gap") <= TOLERANCE_REACH) & (dx >= 0))
    fits = F.col("ma").eqNullSafe(F.col("dimension_axis")) & tx.same_reading(F.col("orientation"), F.col("mo")) & tx.tolerance_fits(F.col("nominal"), F.col("value"))
    return both.where(placed & fits).groupBy(*keys, "mseq").agg(F.min_by("seq", F.struct("gap", "seq")).alias("seq"))


def _attached(rows: pd.DataFrame) -> pd.DataFrame:
    """(page_no, mseq, seq): a page's modifiers in order, each to its nearest number as that stands by then.

    Pages don't matter to each other: the first modifiers of all go at once, then the second ones, and so on.
    """
    rows = rows.assign(axis=pd.factorize(rows["dimension_axis"])[0], reads=pd.factorize(rows["family"])[0]).sort_values(["page_no", "seq"])
    of, to = rows[rows["value"].notna()], rows[rows["value"].isna()]
    page, seq, nominal, axis, reads, free = (to[c].to_numpy() for c in ("page_no", "seq", "nominal", "axis", "reads", "free"))
    own, value, m_axis, m_reads = (of[c].to_numpy() for c in ("page_no", "value", "axis", "reads"))
    start, stop = (np.searchsorted(page, own, side) for side in ("left", "right"))
    place, m_place = (r[["x0", "y0", "x1", "y1", "cx", "cy"]].to_numpy(float) for r in (to, of))
    free, up, share = free.astype(bool), (to["dimension_axis"] == "vertical").to_numpy(), tx.LARGEST_SHARE * np.abs(nominal)
    turn = np.arange(len(of)) - np.searchsorted(own, own)
    by_turn = np.argsort(turn, kind="stable")
    takes, taken = [], []
    for m in np.split(by_turn, np.searchsorted(turn[by_turn], np.arange(1, turn.max(initial=0) + 1))):
        m = m[stop[m] > start[m]]
        if not len(m):
            continue
        n = stop[m] - start[m]
        first = np.cumsum(n) - n
        at, e = np.repeat(np.arange(len(m)), n), np.arange(n.sum()) + np.repeat(start[m] - first, n)
        i = m[at]
        dx, dy = m_place[i, 4] - place[e, 4], place[e, 5] - m_place[i, 5]
        gap = np.sqrt(dx * dx + dy * dy)
        near = np.where(up[e], (np.abs(dx) <= LINE) & (gap <= TOLERANCE_REACH * UPRIGHT) & (dy >= 0), (np.abs(dy) <= LINE) & (gap <= TOLERANCE_REACH) & (dx >= 0))
        near &= (axis[e] == m_axis[i]) & (reads[e] == m_reads[i]) & ((nominal[e] == 0) | (value[i] <= share[e]))
        least = np.minimum.reduceat(np.where(near, gap, np.inf), first)
        hits = np.flatnonzero(near & (gap == least[at]))
        hits = hits[np.unique(at[hits], return_index=True)[1]]
        hits = hits[free[e[hits]]]
        best, m = e[hits], i[hits]
        free[best] = False
        place[best, :2], place[best, 2:4] = np.minimum(place[best, :2], m_place[m, :2]), np.maximum(place[best, 2:4], m_place[m, 2:4])
        place[best, 4:] = (place[best, :2] + place[best, 2:4]) / 2
        takes.append(m)
        taken.append(best)
    m, best = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (takes, taken))
    return pd.DataFrame({"page_no": own[m], "mseq": of["seq"].to_numpy()[m], "seq": seq[best]}).astype("int64")


def attach_modifiers(modifiers: DataFrame, entities: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Entities with their tolerances.

    Modifiers go in order: each finds its nearest number (as nearest_parent has it, but with the boxes
    that earlier modifiers have widened).  A number that has a tolerance takes no other, and a modifier
    doesn't look for a second choice.  A number's box and centre grow by its modifier's.  Only
    pages with modifiers are folded, many in one call.
    """
    place = ["x0", "y0", "x1", "y1", "cx", "cy"]
    none = lambda c: F.coalesce(c, F.lit(""))
    about = [none(F.col("dimension_axis")).alias("dimension_axis"), none(tx.reading_family(F.col("orientation"))).alias("family")]
    read = save(modifiers.select(*keys, "seq", *(F.col(c).cast("double").alias(c) for c in place), *about, "glyph_count", tx.parse_tolerance(F.col("text")).alias("value"), tx.tolerance_text(F.col("text")).alias("shown")), "marks")
    m = read.select(*keys, F.col("seq").alias("mseq"), "value", F.concat(F.lit("±"), "shown").alias("value_text"), *(F.col(c).alias(f"m_{c}") for c in ("x0", "y0", "x1", "y1")), F.col("glyph_count").alias("m_glyphs")).hint("merge")
    marks = read.where(F.col("value").isNotNull() & tx.valid_tolerance(F.col("value"))).select(*keys, "seq", *place, "dimension_axis", "family", "value", F.lit(None).cast("double").alias("nominal"), F.lit(True).alias("free"))
    numbers = entities.where("nominal is not null").select(*keys, "seq", *(F.col(c).cast("double").alias(c) for c in place), *about, F.lit(None).cast("double").alias("value"), "nominal", F.col("tolerance").isNull().alias("free"))
    page = save(numbers.join(marks.select(*keys).distinct(), keys, "left_semi").unionByName(marks), "attachable")
    first = fold_pages(page, keys, _attached, "mseq long, seq long")
    e = entities.join(first.join(m, [*keys, "mseq"]), [*keys, "seq"], "left")
    box = Box.of().merged(Box.of("m_"))
    x, y = box.center()
    new = {"tolerance": F.col("value"), "tolerance_text": F.col("value_text"), "display_text": tx.strip(F.concat_ws(" ", "nominal_text", "value_text")), "glyph_count": F.col("glyph_count") + F.col("m_glyphs"), "cx": x, "cy": y, **box.columns()}
    e = e.withColumn("takes", F.col("mseq").isNotNull()).withColumns({n: F.when(F.col("takes"), c).otherwise(F.col(n)) for n, c in new.items()})
    return e.select(*entities.columns)


def bind_thickness(entities: DataFrame, keys: list[str] = KEYS, reach_mm: float = THICKNESS_MM) -> DataFrame:
    """A lone THK makes the nearest free number in reach 'N THK'.  On pages with a lone THK, thickness
    entities without a number go."""
    e = entities
    is_thk = (F.col("entity_type") == "thickness_dimension") & ((F.upper(tx.strip(F.col("display_text"))) == "THK") | (F.upper(tx.strip(F.col("nominal_text"))) == "THK"))
    e = e.withColumn("is_thk", F.coalesce(is_thk, F.lit(False)))
    e = e.withColumn("page_thk", F.max("is_thk").over(Window.partitionBy(*keys)))
    thk = e.where("is_thk").select(*keys, F.col("seq").alias("tseq"), F.col("cx").alias("tx"), F.col("cy").alias("ty"), *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1"))).hint("merge")
    number = e.where("page_thk and nominal is not null and entity_type <> 'thickness_dimension'").select(*keys, F.col("seq").alias("nseq"), "cx", "cy")
    near = within(thk, number, keys, mm(reach_mm), ("tx", "ty"), ("cx", "cy"))
    met = _greedy(near, keys, "tseq", "nseq", "gap")
    bound = met.join(thk, [*keys, "tseq"]).select(*keys, F.col("nseq").alias("seq"), "t_x0", "t_y0", "t_x1", "t_y1", F.lit(True).alias("bound"))
    out = e.join(bound, [*keys, "seq"], "left").withColumn("bound", F.coalesce("bound", F.lit(False)))
    box = Box.of().merged(Box.of("t_"))
    x, y = box.center()
    short = tx.short_number(F.col("nominal"))
    new = {"entity_type": F.lit("thickness_dimension"), "nominal_text": short, "display_text": F.concat(short, F.lit(" THK")), "cx": x, "cy": y, **box.columns()}
    out = out.withColumns({n: F.when(F.col("bound"), c).otherwise(F.col(n)) for n, c in new.items()})
    lost = F.col("page_thk") & (F.col("entity_type") == "thickness_dimension") & F.col("nominal").isNull()
    return out.where(~lost).select(*entities.columns)


def merge_references(entities: DataFrame, keys: list[str] = KEYS, strict: bool = True) -> DataFrame:
    """A bare number and the (REF) nearest to it become 'N(REF)'.

    On pages where any merged, unmatched numbers and marks go, as the drawing rules have it; unless
    strict they stay.
    """
    shown = tx.strip(F.col("display_text"))
    e = entities.withColumns({"is_ref": F.upper(shown).isin("(REF)", "REF"), "is_number": shown.rlike(r"^\d+(\.\d+)?$")})
    ref = e.where("is_ref").select(*keys, F.col("seq").alias("rseq"), F.col("cx").alias("rx"), F.col("cy").alias("ry"), *(F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1"))).hint("merge")
    number = e.where("is_number").select(*keys, F.col("seq").alias("nseq"), "cx", "cy")
    near = within(ref, number, keys, REFERENCE_REACH, ("rx", "ry"), ("cx", "cy")).where(F.col("gap") < REFERENCE_REACH)
    met = _greedy(near, keys, "rseq", "nseq", "gap").withColumn("merged_as", F.row_number().over(Window.partitionBy(*keys).orderBy("rseq")))
    bound = met.join(ref, [*keys, "rseq"]).select(*keys, F.col("nseq").alias("seq"), "merged_as", "r_x0", "r_y0", "r_x1", "r_y1")
    gone = met.select(*keys, F.col("rseq").alias("seq"), F.lit(True).alias("used"))
    out = e.join(bound, [*keys, "seq"], "left").join(gone, [*keys, "seq"], "left").where("used is null")
    box = Box.of().merged(Box.of("r_"))
    x, y = box.center()
    text = F.concat(shown, F.lit("(REF)"))
    new = {"entity_type": F.lit("reference_dimension"), "display_text": text, "nominal_text": text, "nominal": tx.to_double(shown), "grammar_rule": F.lit("REFERENCE_SUFFIX_MERGE"), "cx": x, "cy": y, "seq": F.lit(MERGED).cast("long") + F.col("merged_as"), **box.columns()}
    any_merged = F.max(F.col("merged_as").isNotNull()).over(Window.partitionBy(*keys))
    out = out.withColumns({"any_merged": any_merged, "bound": F.col("merged_as").isNotNull()})
    if strict:
        out = out.where(~F.col("any_merged") | F.col("bound") | ~(F.col("is_ref") | F.col("is_number")))
    return out.withColumns({n: F.when(F.col("bound"), c).otherwise(F.col(n)) for n, c in new.items()}).select(*entities.columns)


def fuse_stacked_digits(entities: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Unresolved single digits above each other become one vertical number.

    From the bottom up a digit joins if it stands within 8 of the last one's line and its gap is
    usual for the stack so far (the first gap sets it).  On pages where any fused, digits left over go.
    """
    shown = tx.strip(F.col("display_text"))
    loose = (F.col("dimension_axis") == "vertical") & shown.rlike("^[0-9]$") & F.col("orientation").startswith("unresolved")
    e = entities.withColumn("loose", F.coalesce(loose, F.lit(False)))
    group = F.bround(F.col("cx") / 10, 0).cast("long")
    digit = F.struct((-F.col("cy")).alias("k"), "seq", shown.alias("digit"), "cx", "x0", "y0", "x1", "y1", "glyph_count", "axis_bucket")
    stacks = e.where("loose").groupBy(*keys, group.alias("column")).agg(F.array_sort(F.collect_list(digit)).alias("d"), F.min("seq").alias("first")).where(F.size("d") >= 2)
    start = F.transform(F.slice("d", 1, 0), lambda x: F.struct(F.array(x).alias("m"), F.array(F.lit(0.0)).alias("gaps")))

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        before = F.try_element_at(last["m"], F.lit(-1))
        gap, gaps = before["y0"] - x["y1"], last["gaps"]
        mid = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
        usual = F.when(F.size(gaps) > 1, mid(F.array_sort(F.slice(gaps, 2, F.size(gaps))))).otherwise(gap)
        most = F.greatest(usual * 2.5, usual + 8, F.lit(12.0))
        joins = F.coalesce((F.abs(before["cx"] - x["cx"]) <= 8) & (gap > 0) & (gap <= most), F.lit(False))
        grown = F.struct(F.concat(last["m"], F.array(x)).alias("m"), F.concat(gaps, F.array(F.abs(gap))).alias("gaps"))
        alone = F.struct(F.array(x).alias("m"), F.array(F.lit(0.0)).alias("gaps"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(alone)))

    found = stacks.select(*keys, "first", F.posexplode(F.aggregate("d", start, add)).alias("nth", "stack")).where(F.size("stack.m") >= 2)
    part = lambda c, t="double": F.transform("stack.m", lambda x: x[c].cast(t))
    found = found.withColumns({"x0": F.array_min(part("x0")), "y0": F.array_min(part("y0")), "x1": F.array_max(part("x1")), "y1": F.array_max(part("y1")), "shown": F.array_join(part("digit", "string"), "")})
    x, y = Box.of().center()
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("first", "nth")) + F.lit(FUSED)
    fused = found.select(
        *keys, order.cast("long").alias("seq"), F.lit("linear_dimension").alias("entity_type"), F.col("shown").alias("display_text"), tx.to_double(F.col("shown")).alias("nominal"), F.col("shown").alias("nominal_text"),
        F.lit("vertical").alias("orientation"), F.lit("vertical").alias("dimension_axis"), F.get("stack.m", F.lit(0))["axis_bucket"].alias("axis_bucket"), F.lit("bottom_to_top").alias("reading_direction"), F.lit("VERTICAL_DIGIT_FUSION").alias("grammar_rule"),
        "x0", "y0", "x1", "y1", x.alias("cx"), y.alias("cy"), F.aggregate(part("glyph_count", "int"), F.lit(0), lambda a, b: a + b).alias("glyph_count"),
    )
    pages = fused.select(*keys).distinct().withColumn("fused_here", F.lit(True))
    kept = e.join(pages, keys, "left").where("fused_here is null or not loose").select(*entities.columns)
    return kept.unionByName(fused, allowMissingColumns=True)
