"""Joins in space: regions, nearest drawings, nearest entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.functions.geometry import Box, distance
from linework.operators.chains import KEYS
from linework.sources.scratch import save

PAGE = ["doc_id", "page"]


#: The grid for overlaps: cells of CELL at its finest level and STEP times that at each next one; the last level is one cell.
CELL, STEP, LEVELS = 128.0, 4, 12
#: Levels that the regions of a page stand at, at most, and a page's regions up to which a box tries them all.
REGION_LEVELS, FEW_REGIONS = 4, 32
#: Sides of the cells that drawings are sought in, from fine to coarse, and a page's drawings up to which all are tried.
SIDES, FEW_DRAWINGS = (16.0, 64.0, 256.0, 1024.0, 4096.0, 16384.0), 256


def _cell(c: Column, side) -> Column:
    return F.floor(c / side).cast("long")


def _sound(box: Box) -> Column:
    """Whether all coordinates are numbers."""
    ok = F.lit(True)
    for c in (box.x0, box.y0, box.x1, box.y1):
        ok &= c.isNotNull() & ~F.isnan(c)
    return ok


def _level(box: Box) -> Column:
    """The finest level of the grid whose cells are as large as a box (and whose cells can be numbered where it is)."""
    n = box.normalised()
    size = F.greatest(n.x1 - n.x0, n.y1 - n.y0, *(F.abs(c) / 2**31 for c in (n.x0, n.y0, n.x1, n.y1)))
    return sum(((size > CELL * STEP**k).cast("int") for k in range(LEVELS)), F.lit(0))


def _grid(c: Column, level: Column) -> Column:
    return F.when(level >= LEVELS, F.lit(0).cast("long")).otherwise(_cell(c, F.lit(CELL) * F.pow(F.lit(float(STEP)), level)))


def _region_levels(regions: DataFrame) -> DataFrame:
    """regions with their level, raised so that a page has REGION_LEVELS of them at most."""
    page = Window.partitionBy(*PAGE)
    r = regions.withColumn("level", _level(Box.of("r_"))).withColumns({"least": F.min("level").over(page), "most": F.max("level").over(page)})
    step = F.ceil((F.col("most") - F.col("least") + 1) / REGION_LEVELS)
    return r.withColumn("level", (F.col("most") - F.floor((F.col("most") - F.col("level")) / step) * step).cast("int")).drop("least", "most")


def _around(gx: Column, gy: Column) -> Column:
    """An array of struct(gx, gy): a cell and the eight about it."""
    return F.array(*(F.struct((gx + i).alias("gx"), (gy + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))


def _meets(box: Box, region: Box, mode: Column | None) -> Column:
    meets = box.intersects(region)
    return meets if mode is None else F.when(mode == "center", box.center_inside(region)).otherwise(meets)


def clip(rows: DataFrame, regions: DataFrame, by_mode: bool = True) -> DataFrame:
    """rows once for each region of their page that they meet, with region_id.

    by_mode: a region's glyph_mode 'center' asks for the centre inside, any other for overlap.
    On pages of up to FEW_REGIONS a box tries them all, where a task holds the regions of its pages; on others the grid
    finds those near it.  Boxes and regions with a coordinate that is null or not a number meet nothing.
    """
    side = [*(F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")), *(["glyph_mode"] if by_mode else [])]
    r = regions.select(*PAGE, "region_id", *side).where(_sound(Box.of("r_")))
    rows = rows.where(_sound(Box.of()))
    dense = save(r.groupBy(*PAGE).agg(F.count("*").alias("n")).where(F.col("n") > FEW_REGIONS).select(*PAGE), "dense-pages")
    few, crowded = r, not dense.isEmpty()
    if crowded:
        few = r.join(dense, PAGE, "left_anti")
    out = rows.join(few.hint("shuffle_hash"), PAGE).where(_meets(Box.of(), Box.of("r_"), F.col("glyph_mode") if by_mode else None)).select(*rows.columns, "region_id")
    if crowded:
        out = out.union(_clip_by_cells(rows.join(dense, PAGE, "left_semi"), r.join(dense, PAGE, "left_semi"), by_mode))
    return out


def _clip_by_cells(rows: DataFrame, r: DataFrame, by_mode: bool) -> DataFrame:
    """clip by the grid, of sound boxes.

    A box and a region meet at the level of the larger one of them, where neither is larger than a cell: the box stands
    in the cell of its corner, once for each level of its page's regions (REGION_LEVELS at most), and the region looks
    into the cells it may reach boxes of.  So no box makes many rows, whatever its size; infinite ones are as large as
    the page.
    """
    box, region = Box.of(), Box.of("r_")
    r = _region_levels(r)
    near = rows.join(r.groupBy(*PAGE).agg(F.collect_set("level").alias("levels")), PAGE).withColumn("own", _level(box))
    near = near.withColumn("at", F.explode(F.array_distinct(F.transform("levels", lambda x: F.greatest(x, F.col("own"))))))
    b, n = box.normalised(), region.normalised()
    near = near.withColumns({"gx": _grid(b.x0, F.col("at")), "gy": _grid(b.y0, F.col("at"))})
    areas = r.withColumn("at", F.explode(F.sequence("level", F.lit(LEVELS))))
    reach = lambda a, z: F.sequence(_grid(a, F.col("at")) - (F.col("at") < LEVELS).cast("long"), _grid(z, F.col("at")))
    areas = areas.withColumn("gx", F.explode(reach(n.x0, n.x1))).withColumn("gy", F.explode(reach(n.y0, n.y1)))
    both = near.join(areas, [*PAGE, "at", "gx", "gy"])
    meets = _meets(box, region, F.col("glyph_mode") if by_mode else None)
    return both.where((F.col("at") == F.greatest("own", "level")) & meets).select(*rows.columns, "region_id")


def within(left: DataFrame, right: DataFrame, keys: list[str], reach: float, at: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Pairs of rows of a page whose points are at most reach apart, with their gap: rows of left look into
    the nine cells of that side about them."""
    a = left.withColumn("g", F.explode(_around(*(_cell(F.col(c), reach) for c in at)))).select(*left.columns, "g.gx", "g.gy").hint("merge")
    b = right.withColumns({g: _cell(F.col(c), reach) for g, c in zip(("gx", "gy"), other, strict=True)})
    both = a.join(b, [*keys, "gx", "gy"]).drop("gx", "gy")
    return both.withColumn("gap", distance(*(F.col(c) for c in (*at, *other)))).where(F.col("gap") <= reach)


def _best(pairs: DataFrame, keys: list[str]) -> DataFrame:
    gap = distance(F.col("cx"), F.col("cy"), F.col("dx"), F.col("dy"))
    return pairs.groupBy(*keys, "seq").agg(F.min(gap).alias("distance"), F.min_by("box", F.struct(gap, F.col("dseq"))).alias("box"))


def _search(points: DataFrame, drawings: DataFrame, keys: list[str]) -> DataFrame:
    """points with the level at which they must look: the side of the finest cells of which one with a
    drawing lies about them bounds the distance, and cells of four times that side hold all that is nearer.

    The last level is one cell for the whole page.
    """
    levels = lambda x, y: F.array(*(F.struct(F.lit(n).alias("level"), _cell(x, s).alias("gx"), _cell(y, s).alias("gy")) for n, s in enumerate(SIDES)))
    held = drawings.select(*keys, F.explode(levels(F.col("dx"), F.col("dy"))).alias("g")).select(*keys, "g.*").distinct()
    looks = points.select(*keys, "seq", F.explode(levels(F.col("cx"), F.col("cy"))).alias("g")).select(*keys, "seq", "g.level", F.explode(_around(F.col("g.gx"), F.col("g.gy"))).alias("g")).select(*keys, "seq", "level", "g.*")
    found = looks.join(held, [*keys, "level", "gx", "gy"]).groupBy(*keys, "seq").agg(F.min("level").alias("level"))
    found = points.join(found, [*keys, "seq"], "left").withColumn("level", F.coalesce("level", F.lit(len(SIDES))))
    return found.withColumn("level", F.least(F.col("level") + 1, F.lit(len(SIDES))))


def _nearest_by_cells(points: DataFrame, drawings: DataFrame, keys: list[str]) -> DataFrame:
    points = _search(points, drawings, keys)
    side = F.get(F.array(*map(F.lit, SIDES)), F.col("level"))
    own = lambda x, y: [F.coalesce(_cell(c, side), F.lit(0)) for c in (x, y)]
    whole = F.array(F.struct(F.lit(0).cast("long").alias("gx"), F.lit(0).cast("long").alias("gy")))
    looks = points.withColumn("g", F.explode(F.when(F.col("level") < len(SIDES), _around(*own(F.col("cx"), F.col("cy")))).otherwise(whole))).select(*points.columns, "g.gx", "g.gy")
    dealt = drawings.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(SIDES)))))
    dealt = dealt.withColumns(dict(zip(("gx", "gy"), own(F.col("dx"), F.col("dy")), strict=True)))
    return _best(looks.join(dealt, [*keys, "level", "gx", "gy"]), keys)


def nearest_drawing(entities: DataFrame, drawings: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """entities with distance and near_x0..near_y1 of the page's drawing with the nearest centre.

    The first drawn wins a tie; a page without drawings gives an infinite distance and no box.  On pages
    of up to FEW_DRAWINGS an entity tries them all, which come as one array; on others it looks into the cells about it, of
    a size that is sure to hold the nearest one.
    """
    x, y = Box.of().center()
    d = drawings.select(*keys, F.col("seq").alias("dseq"), x.alias("dx"), y.alias("dy"), F.struct("x0", "y0", "x1", "y1").alias("box"))
    dense = save(drawings.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > FEW_DRAWINGS).select(*keys), "dense-pages")
    few, crowded = d, not dense.isEmpty()
    if crowded:
        few = d.join(dense, keys, "left_anti")
    held = few.groupBy(*keys).agg(F.collect_list(F.struct("dseq", "dx", "dy", "box")).alias("drawn")).hint("merge")
    gap = lambda g: distance(F.col("cx"), F.col("cy"), g["dx"], g["dy"])
    tried = F.transform("drawn", lambda g: F.struct(gap(g).alias("gap"), g["dseq"].alias("dseq"), g["box"].alias("box")))
    out = entities.join(held, keys, "left").withColumn("tried", tried)
    out = out.withColumns({"distance": F.array_min("tried.gap"), "box": F.array_min("tried")["box"]}).drop("drawn", "tried")
    if crowded:
        many = _nearest_by_cells(entities.select(*keys, "seq", "cx", "cy").join(dense, keys, "left_semi"), d.join(dense, keys, "left_semi"), keys)
        many = many.select(*keys, "seq", F.col("distance").alias("m_distance"), F.col("box").alias("m_box"))
        out = out.join(many, [*keys, "seq"], "left").withColumns({"distance": F.coalesce("m_distance", "distance"), "box": F.coalesce("m_box", "box")}).drop("m_distance", "m_box")
    return out.withColumn("distance", F.coalesce("distance", F.lit(float("inf")))).withColumns({f"near_{c}": F.col(f"box.{c}") for c in ("x0", "y0", "x1", "y1")}).drop("box")


def nearest_to_point(entities: DataFrame, points: DataFrame) -> DataFrame:
    """Per point (doc_id, page, point_id): candidate_count, the entity (struct) whose box is nearest, its centre and snap_distance.

    entities have region_id = point_id and text_bbox; the first by seq wins a tie.  Ids count within their page.
    """
    keys = [*PAGE, "point_id"]
    e = entities.withColumnRenamed("region_id", "point_id")
    fields = [c for c in e.columns if c not in ("point_id", "doc_id")]
    p = points.select(*keys, "x", "y", "radius")
    box = Box.from_array(F.col("text_bbox"))
    both = p.join(e, keys).withColumn("gap", box.to_point(F.col("x"), F.col("y")))
    best = both.groupBy(*keys).agg(F.count("*").alias("candidate_count"), F.min_by(F.struct(*fields), F.struct("gap", "seq")).alias("selected"), F.min("gap").alias("gap"))
    sx, sy = Box.from_array(F.col("selected.text_bbox")).center()
    out = p.join(best, keys, "left")
    return out.select(*keys, "x", "y", "radius", F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), "selected", F.when(F.col("selected").isNotNull(), F.array(sx, sy)).alias("center"), F.bround("gap", 3).alias("snap_distance"))
