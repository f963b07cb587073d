"""From glyphs to chains: page thresholds, neighbours, axes, components and their splits.

Every operator takes and returns DataFrames with a set of key columns (document, page and, in
region queries, the region), a sequence number seq that says which row came first, and boxes in
x0, y0, x1, y1.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linework.functions.text import OPERATORS, mostly_digits, strip
from linework.operators.linking import roots
from linework.sources.scratch import save

KEYS = ["doc_id", "page"]
#: The longest chain, and how much wider than the median a gap must be to break one (fixed values).
MOST_GLYPHS, BREAK = 12, 2.2
#: Glyphs of a page that one task holds; tiles of larger pages are at least so many times as wide as glyphs reach.
TILE_GLYPHS, LEAST_TILE = 200_000, 8
#: Glyphs that go to Python at once, many pages together, and how many glyphs one may have about it (on average) to try them all, in blocks.
BATCH_GLYPHS, FEW_ABOUT, BLOCK = 50_000, 400, 1_000_000


def with_metrics(glyphs: DataFrame) -> DataFrame:
    """Centres and sizes (0.1 at least)."""
    return glyphs.withColumns({
        "cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2,
        "w": F.greatest(F.col("x1") - F.col("x0"), F.lit(0.1)), "h": F.greatest(F.col("y1") - F.col("y0"), F.lit(0.1)),
    })


def _tolerances(w, h) -> dict:
    """line_tol, col_tol, h_gap_max, v_gap_max, size_tol from the width and height of a page's median glyph."""
    at_least = lambda c, k, least: F.greatest(c * k, F.lit(least))
    return {"line_tol": at_least(h, 0.5, 2.0), "col_tol": at_least(w, 0.35, 2.0), "h_gap_max": at_least(w, 1.8, 6.0), "v_gap_max": at_least(h, 1.8, 6.0), "size_tol": at_least(h, 0.35, 0.5)}


def _middle(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, median) of counts(keys, value, n), by counting: the mean of the two values in the middle."""
    page = Window.partitionBy(*keys)
    upto = F.sum("n").over(page.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    c = counts.withColumns({"upto": upto, "total": F.sum("n").over(page)})
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("value")))
    return c.groupBy(*keys).agg(((at(F.ceil(F.col("total") / 2)) + at(F.floor(F.col("total") / 2) + 1)) / 2).alias("median"))


def page_sizes(glyphs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per page: mw and mh (of the median glyph), on_page (how many glyphs), left, top, right, bottom of their centres, and
    of their font sizes the least, the most and how many are known.

    Equal sizes are counted where they are read, so what is shuffled and sorted is a row for each size
    of a page, however many glyphs have it.
    """
    ends = [F.min("cx").alias("left"), F.min("cy").alias("top"), F.max("cx").alias("right"), F.max("cy").alias("bottom")]
    ends += [F.min("size").alias("least_size"), F.max("size").alias("most_size"), F.count("size").alias("sized")]
    sizes = save(glyphs.groupBy(*keys, "w", "h").agg(F.count("*").alias("n"), *ends), "sizes")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).alias("value"), F.col("n").alias("n")) for c in ("w", "h")))).alias("v")
    counts = sizes.select(*keys, each).select(*keys, "v.*").where("value is not null").groupBy(*keys, "of", "value").agg(F.sum("n").alias("n"))
    medians = _middle(counts, [*keys, "of"]).groupBy(*keys).agg(*(F.max(F.when(F.col("of") == c, F.col("median"))).alias(f"m{c}") for c in ("w", "h")))
    pages = sizes.groupBy(*keys).agg(F.sum("n").alias("on_page"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.min("least_size").alias("least_size"), F.max("most_size").alias("most_size"), F.sum("sized").alias("sized"))
    return pages.join(medians, keys)


def thresholds(glyphs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per page, from the median glyph: line_tol, col_tol, h_gap_max, v_gap_max, size_tol."""
    med = page_sizes(glyphs, keys)
    return med.select(*keys, *(c.alias(n) for n, c in _tolerances(F.col("mw"), F.col("mh")).items()))


def with_thresholds(glyphs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """glyphs (with metrics) with their page's thresholds, on_page and batches, how many batches of BATCH_GLYPHS all glyphs
    make; where there are pages of over TILE_GLYPHS glyphs also with tile, how they are cut: struct(left, top, side,
    reach), null on other pages; where there are pages whose font sizes differ beyond the tolerance also with uneven."""
    pages = page_sizes(glyphs, keys)
    pages = pages.select(*keys, "on_page", "left", "top", "right", "bottom", "least_size", "most_size", "sized", *(c.alias(n) for n, c in _tolerances(F.col("mw"), F.col("mh")).items()))
    reach = F.greatest("line_tol", "col_tol", "h_gap_max", "v_gap_max")
    side = F.greatest(reach * LEAST_TILE, F.sqrt((F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")) * TILE_GLYPHS / F.col("on_page")))
    pages = pages.withColumn("tile", F.when(F.col("on_page") > TILE_GLYPHS, F.struct("left", "top", side.alias("side"), reach.alias("reach"))))
    pages = pages.withColumn("uneven", F.coalesce((F.col("sized") < F.col("on_page")) | (F.col("most_size") - F.col("least_size") > F.col("size_tol")), F.lit(True)))
    pages = save(pages.drop("left", "top", "right", "bottom", "least_size", "most_size", "sized"), "thresholds")
    seen = pages.agg(F.sum("on_page").alias("n"), F.count("tile").alias("cut"), F.count_if("uneven").alias("uneven")).first()
    pages = pages.withColumn("batches", F.lit(max(1, math.ceil((seen["n"] or 0) / BATCH_GLYPHS))))
    return glyphs.join(pages.drop(*([] if seen["cut"] else ["tile"]), *([] if seen["uneven"] else ["uneven"])), keys)


def _bounds(values: np.ndarray, at: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(first, stop) in sorted distinct values of those at most reach from each of at, by the difference itself."""
    lo, hi, last = np.searchsorted(values, at - reach), np.searchsorted(values, at + reach, "right"), len(values) - 1
    while (m := (lo > 0) & (at - values[lo - 1] <= reach)).any():
        lo[m] -= 1
    while (m := (lo <= last) & (at - values[np.minimum(lo, last)] > reach)).any():
        lo[m] += 1
    while (m := (hi <= last) & (values[np.minimum(hi, last)] - at <= reach)).any():
        hi[m] += 1
    while (m := (hi > 0) & (values[hi - 1] - at > reach)).any():
        hi[m] -= 1
    return lo, np.maximum(lo, hi)


def _near(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, reach: float, tol: float) -> np.ndarray:
    """For each query how many points are at most reach away in x, but not at 0, and at most tol in y.

    A sweep in order of x: how many of the first k points rank below a given y is a sum over blocks of 1, 2, 4, ...
    points, each with its ranks in order, one size of block at a time.
    """
    if not len(x):
        return np.zeros(len(qx), np.int64)
    xs, at_x = np.unique(x, return_inverse=True)
    ys, rank = np.unique(y, return_inverse=True)
    order = np.argsort(at_x, kind="stable")
    before, rank = np.searchsorted(at_x[order], np.arange(len(xs) + 1)), rank[order]
    (x0, x1), (y0, y1) = _bounds(xs, qx, reach), _bounds(ys, qy, tol)
    own0, own1 = np.searchsorted(xs, qx), np.searchsorted(xs, qx, "right")
    k = before[np.stack([x1, x0, own0, own1])]
    sign = np.array([1, -1, 1, -1])[:, None]
    total, wide = np.zeros(len(qx), np.int64), len(ys) + 1
    for level in range(len(x).bit_length()):
        keys = np.sort((np.arange(len(x)) >> level) * wide + rank, kind="stable")
        block = (k >> (level + 1)) << 1
        found = np.searchsorted(keys, block * wide + y1) - np.searchsorted(keys, block * wide + y0)
        total += (sign * np.where(k >> level & 1, found, 0)).sum(axis=0)
    return total


def _codes(table: pa.Table, names: list[str]) -> np.ndarray:
    """A number for each row, the same for rows that are equal in the named columns."""
    code = np.zeros(table.num_rows, np.int64)
    for name in names:
        of = table[name].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (len(of) + 1) + of + 1, return_inverse=True)[1].reshape(-1)
    return code


def _swept(x: np.ndarray, y: np.ndarray, size: np.ndarray, own: np.ndarray, reach: float, tol: float, fit: float) -> np.ndarray:
    """_near for the own ones among glyphs of one page and font (0 for others): sizes that fit the same sizes go together."""
    near = np.zeros(len(x), np.int64)
    order = np.argsort(size, kind="stable")
    sizes, at = np.unique(size[order], return_inverse=True)
    lo, hi = _bounds(sizes, sizes, fit)
    for a, b in np.unique(np.stack([lo, hi], axis=1), axis=0):
        p, q = order[(at >= a) & (at < b)], order[(lo[at] == a) & (hi[at] == b)]
        q = q[own[q]]
        near[q] = _near(x[p], y[p], x[q], y[q], reach, tol)
    return near


def _about(group: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray, own: np.ndarray, reach: np.ndarray, tol: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """How many of its group (a page's glyphs of one font; it has one reach, tol and fit) each own glyph has about it.

    Many groups are laid one behind the other along x, so all find theirs in one sorted column; each pair in reach is
    then judged by its differences.  Crowded groups, and all where a place is no finite number, are swept.
    """
    near, order = np.zeros(len(x), np.int64), np.lexsort((x, group))
    group, x, y, size, own, reach, tol, fit = (c[order] for c in (group, x, y, size, own, reach, tol, fit))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    length = np.diff(np.r_[starts, len(x)])
    crowded = np.ones(len(starts), bool)
    with np.errstate(all="ignore"):
        span = x.max() - x.min() + 2 * reach.max() + 1
        far = span * len(starts)
    if far < 1e12 and np.isfinite(x).all():
        along = np.repeat(np.arange(len(starts)), length) * span + (x - x.min())
        more = reach + far * 2.0**-48
        lo, hi = np.searchsorted(along, along - more), np.searchsorted(along, along + more, "right")
        held = np.where(own, hi - lo, 0)
        crowded = np.add.reduceat(held, starts) > FEW_ABOUT * length
        of = np.flatnonzero(own & ~np.repeat(crowded, length))
        upto = np.cumsum(held[of])
        for part in np.split(of, np.searchsorted(upto, np.arange(BLOCK, upto[-1], BLOCK))) if len(of) else ():
            n = held[part]
            at, other = np.repeat(np.arange(len(part)), n), np.arange(n.sum()) + np.repeat(lo[part] - np.cumsum(n) + n, n)
            i = part[at]
            gap = np.abs(x[other] - x[i])
            met = (gap > 0) & (gap <= reach[i]) & (np.abs(y[other] - y[i]) <= tol[i]) & (np.abs(size[other] - size[i]) <= fit[i])
            near[order[part]] = np.bincount(at[met], minlength=len(part))
    for k in np.flatnonzero(crowded):
        g = slice(starts[k], starts[k] + length[k])
        near[order[g]] = _swept(x[g], y[g], size[g], own[g], reach[g.start], tol[g.start], fit[g.start])
    return near


def _counted(batch: pa.Table, by: list[str]) -> pa.Table:
    """Pages or tiles (told apart by by) with h_near and v_near; rows that aren't own only count for others."""
    cx, cy, size, own, h_gap, v_gap, line, col, fit = (batch[c].to_numpy() for c in ("cx", "cy", "size", "own", "h_gap_max", "v_gap_max", "line_tol", "col_tol", "size_tol"))
    group = _codes(batch, [*by, "font"])
    out = batch.drop_columns(["own"])
    for name, found in (("h_near", _about(group, cx, cy, size, own, h_gap, line, fit)), ("v_near", _about(group, cy, cx, size, own, v_gap, col, fit))):
        out = out.append_column(name, pa.array(found))
    return out if own.all() else out.filter(pa.array(own))


def neighbor_counts(glyphs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """glyphs (with metrics and thresholds) with h_near and v_near: how many others of its font and size each has within
    reach along a line or a column.

    Pages are counted many at once, BATCH_GLYPHS or so; a page of over TILE_GLYPHS glyphs is cut into tiles, whose
    glyphs also see those within reach beyond their edges.
    """
    g, by = glyphs.withColumn("own", F.lit(True)), keys
    if "tile" in glyphs.columns:
        nth = lambda c, edge, by: F.coalesce(F.floor((F.col(c) + by - F.col(f"tile.{edge}")) / F.col("tile.side")).cast("long"), F.lit(0))
        spread = lambda c, edge: F.explode(F.sequence(nth(c, edge, -F.col("tile.reach")), nth(c, edge, F.col("tile.reach"))))
        g = g.withColumn("tile_x", spread("cx", "left")).withColumn("tile_y", spread("cy", "top"))
        g = g.withColumn("own", (F.col("tile_x") == nth("cx", "left", F.lit(0.0))) & (F.col("tile_y") == nth("cy", "top", F.lit(0.0))))
        by = [*keys, "tile_x", "tile_y"]
    names = [*glyphs.drop("tile").columns, "h_near", "v_near"]
    schema = glyphs.drop("tile").withColumns({"h_near": F.lit(0).cast("long"), "v_near": F.lit(0).cast("long")}).schema
    batch = F.pmod(F.xxhash64(*by), F.col("batches")).alias("batch")
    return g.drop("tile").groupBy(batch).applyInArrow(lambda pages: _counted(pages, by).select(names), schema)


def with_axes(glyphs: DataFrame) -> DataFrame:
    """dimension_axis from shape and neighbours, and axis_bucket: its row or column on the page."""
    tall = (F.col("h") > F.col("w") * 1.15) & (F.col("v_near") >= F.col("h_near"))
    wide = (F.col("w") > F.col("h") * 1.15) & (F.col("h_near") > F.col("v_near"))
    stacked = F.col("v_near") > F.col("h_near")
    axis = F.when(tall, "vertical").when(wide, "horizontal").when(stacked, "vertical").otherwise("horizontal")
    glyphs = glyphs.withColumn("dimension_axis", axis)
    up = F.col("dimension_axis") == "vertical"
    bucket = F.bround(F.when(up, F.col("cx") / F.col("col_tol")).otherwise(F.col("cy") / F.col("line_tol")), 0).cast("int")
    return glyphs.withColumns({"axis_bucket": bucket, "along": F.when(up, -F.col("cy")).otherwise(F.col("cx")), "reach": F.when(up, F.col("v_gap_max")).otherwise(F.col("h_gap_max"))})


def reading_order(axis, cx, cy):
    """What sorts the glyphs of a group: upwards, along x and then y if angled, or along x."""
    return F.struct(F.when(axis == "vertical", -cy).otherwise(cx).alias("k"), F.when(axis == "angled", cy).otherwise(F.lit(0.0)).alias("then"))


def chain_text(glyphs, axis):
    """The characters of an ordered array of glyphs, trimmed; upwards a ± stands apart from a digit before it."""
    text = F.array_join(F.transform(glyphs, lambda g: g["char"]), "")
    return strip(F.when(axis == "vertical", F.regexp_replace(text, r"([0-9])(±)", "$1 $2")).otherwise(text))


LINE = ["dimension_axis", "axis_bucket", "font"]


def _linked(rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Components of lines whose sizes differ too much for islands: sizes must fit pair by pair.

    Rows of a line are sorted, so the pairs in reach are those one, two, ... places apart until none is.
    """
    line = rows.groupby([*keys, *LINE], sort=False, dropna=False).ngroup()
    rows = rows.assign(line=line).sort_values(["line", "along", "seq"], kind="stable").reset_index(drop=True)
    line, k, size, seq, reach, fits = (rows[c].to_numpy() for c in ("line", "along", "size", "seq", "reach", "size_tol"))
    left, right, i = [], [], np.arange(len(rows))
    for apart in range(1, len(rows)):
        i = i[i < len(rows) - apart]
        gap = k[i + apart] - k[i]
        near = (line[i] == line[i + apart]) & (gap <= reach[i])
        i, gap = i[near], gap[near]
        if not len(i):
            break
        fit = (gap > 0) & (np.abs(size[i + apart] - size[i]) <= fits[i])
        left.append(i[fit])
        right.append(i[fit] + apart)
    i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
    root = roots(i, j, len(rows))
    return rows.drop(columns="line").assign(component=pd.Series(seq).groupby(root).transform("min"))


def with_spread(glyphs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """glyphs with how much the sizes of their line differ."""
    line = Window.partitionBy(*keys, *LINE)
    return glyphs.withColumn("spread", F.max("size").over(line) - F.min("size").over(line))


def all_even(glyphs: DataFrame) -> bool:
    """Whether with_thresholds found no page whose font sizes differ beyond the tolerance."""
    return "batches" in glyphs.columns and "uneven" not in glyphs.columns


def _islands(glyphs: DataFrame, line: list[str]) -> DataFrame:
    """glyphs with component where all sizes of a line fit each other."""
    ordered, island = Window.partitionBy(*line).orderBy("along", "seq"), Window.partitionBy(*line, "island")
    cut = F.col("along") - F.lag("along").over(ordered) > F.col("reach")
    g = glyphs.withColumn("island", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(ordered))
    alone = F.max("along").over(island) == F.min("along").over(island)
    return g.withColumn("component", F.when(alone, F.col("seq")).otherwise(F.min("seq").over(island))).drop("island")


def components(glyphs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """glyphs with component: the least seq of those linked with it along its line.

    A line is an axis bucket of one font, as wide as the tolerance across, so links are gaps in one
    sorted column: an island ends where the gap is too large, and one at a single position falls
    apart.  Lines whose sizes spread beyond the tolerance take the exact pairwise way, many lines at a time; where
    with_thresholds found no uneven page there are none, and glyphs are read once.
    """
    line = [*keys, *LINE]
    if all_even(glyphs):
        return _islands(glyphs, line)
    g = save(with_spread(glyphs, keys), "spread")
    even = _islands(g.where(F.col("spread") <= F.col("size_tol")), line)
    mixed = g.where(F.col("spread") > F.col("size_tol"))
    schema = mixed.withColumn("component", F.lit(0).cast("long")).schema
    dealt = [F.pmod(F.xxhash64(*line), F.col("batches")).alias("batch")] if "batches" in g.columns else keys
    mixed = mixed.groupBy(*dealt).applyInPandas(lambda rows: _linked(rows, keys), schema)
    return even.unionByName(mixed).drop("spread", "uneven")


def split_components(glyphs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """glyphs with chunk and piece: components broken at wide gaps and into at most MOST_GLYPHS.

    Components with a tolerance operator stay whole.  A long chunk that isn't numeric falls into
    single glyphs, a numeric one into slices.
    """
    comp = [*keys, "dimension_axis", "axis_bucket", "component"]
    ordered, whole = Window.partitionBy(*comp).orderBy("along", "seq"), Window.partitionBy(*comp)
    g = glyphs.withColumn("gap", F.abs(F.col("along") - F.lag("along").over(ordered)))
    g = g.withColumns({"has_operator": F.max(F.col("char").isin(*OPERATORS)).over(whole), "members": F.count("*").over(whole), "usual": F.median("gap").over(whole)})
    usual = F.when(F.coalesce("usual", F.lit(0.0)) == 0, 1.0).otherwise(F.col("usual"))
    breaks = ~F.col("has_operator") & (F.col("members") >= 3) & (F.col("gap") > BREAK * usual)
    g = g.withColumn("chunk", F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(ordered))
    chunk, in_chunk = Window.partitionBy(*comp, "chunk"), Window.partitionBy(*comp, "chunk").orderBy("along", "seq")
    g = g.withColumns({"length": F.count("*").over(chunk), "nth": F.row_number().over(in_chunk) - 1})
    long = ~F.col("has_operator") & (F.col("length") > MOST_GLYPHS)
    text = chain_text(F.array_sort(F.collect_list(F.when(long, F.struct("along", "seq", "char"))).over(chunk)), F.col("dimension_axis"))
    piece = F.when(~long, 0).when(mostly_digits(text), F.floor(F.col("nth") / MOST_GLYPHS)).otherwise(F.col("nth"))
    return g.withColumn("piece", piece.cast("int")).drop("gap", "usual", "members", "length", "nth")


def stays_whole(has_operator, glyphs):
    """Whether split_components sees at once that a component stays one piece: its gaps differ by less than BREAK times, and
    it isn't long.  glyphs is its ordered array."""
    along = F.transform(glyphs, lambda g: g["along"])
    steps = F.zip_with(F.slice(along, 2, F.size(along)), along, lambda x, y: F.abs(x - y))
    steps = F.slice(steps, 1, F.greatest(F.size(along) - 1, F.lit(0)))
    even = F.forall(along, lambda x: x.isNotNull()) & (F.array_max(steps) <= F.array_min(steps) * BREAK)
    return F.coalesce(has_operator | (F.size(glyphs) <= MOST_GLYPHS) & ((F.size(glyphs) < 3) | even) & has_operator.isNotNull(), F.lit(False))


def singleton_kind(axis, h_near):
    """Orientation of a lone glyph."""
    return F.when(axis == "vertical", "unresolved_vertical_fragment").when(h_near > 0, "unresolved_horizontal_fragment").otherwise("isolated_glyph")
