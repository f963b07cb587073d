"""The page plans: whole documents, regions and points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linework.functions import text as tx
from linework.functions.geometry import Box
from linework.operators import chains as ch
from linework.operators import entities as en
from linework.operators import grammar, matching, registry, spatial
from linework.sources.scratch import save

REGION_KEYS = ["doc_id", "page", "region_id"]


def page_chains(glyphs: DataFrame, keys: list[str] = ch.KEYS) -> DataFrame:
    """Glyphs to chains: thresholds, axes, components, grammar and single use of glyphs.

    Neighbours are counted page by page or tile by tile; all that follows is dealt by line, so a page of any
    size is the work of many tasks: once for all steps where sizes are even.  Components whose gaps are even
    aren't taken apart.
    """
    g = ch.with_axes(ch.neighbor_counts(ch.with_thresholds(ch.with_metrics(glyphs), keys), keys))
    line = [*keys, "dimension_axis", "axis_bucket"]
    g = ch.components(g.repartition(*line), keys) if ch.all_even(g) else ch.components(g, keys).repartition(*line)
    groups = save(registry.ordered(grammar.whole(g, keys), keys), "groups")
    return registry.chains(grammar.split(groups, keys), keys)


def page_entities(glyphs: DataFrame, keys: list[str] = ch.KEYS) -> DataFrame:
    """Glyphs to deduplicated entities with their thickness marks bound.

    A chain that starts with ± can't be: operators are tokens of their own and are never emitted.  So
    there is no lone tolerance to attach here.
    """
    found = save(en.with_pair_columns(en.candidates(page_chains(glyphs, keys))), "candidates")
    numbers = matching.form_pairs(found, keys).where(F.col("grammar_fused") | tx.is_nominal(F.col("text")))
    best = save(en.deduplicate(en.sanitize(en.build(numbers)), keys), "entities")
    return save(matching.bind_thickness(best, keys), "bound")


def finish(entities: DataFrame, drawings: DataFrame, sheets: DataFrame, keys: list[str] = ch.KEYS, margins: bool = True) -> DataFrame:
    """Nearest drawings, stacked digits, export rules and the export schema.

    A lone (REF) is no candidate (it has no number), so there is none to merge here.
    """
    near = save(spatial.nearest_drawing(entities, drawings, keys), "placed")
    return en.export_records(en.exportable(matching.fuse_stacked_digits(near, keys), sheets, keys, margins), keys)


def extract_document(glyphs: DataFrame, drawings: DataFrame, sheets: DataFrame) -> DataFrame:
    """Every page's exported dimensions."""
    return finish(page_entities(glyphs), drawings, sheets)


def clip_classes(clipped: DataFrame, drawn: DataFrame) -> DataFrame:
    """(doc_id, page, region_id, first_id): regions of a page that hold the same glyphs and drawings have one first_id,
    the least of theirs; regions without glyphs are left out.

    Sets are told apart by their size and 128 bits of hash over their rows' numbers.
    """
    held = lambda rows, n: rows.groupBy(*REGION_KEYS).agg(F.struct(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), "seq")).alias(f"h{k}") for k in (1, 2))).alias(n))
    both = held(clipped, "glyphs").join(held(drawn, "drawings"), REGION_KEYS, "left")
    alike = Window.partitionBy("doc_id", "page", "glyphs", "drawings")
    return both.select(*REGION_KEYS, F.min("region_id").over(alike).alias("first_id"))


def extract_regions(glyphs: DataFrame, drawings: DataFrame, sheets: DataFrame, regions: DataFrame) -> DataFrame:
    """Per region the dimensions of what it holds, as if that were the page.

    Glyphs are clipped first, so thresholds are the region's own and its result isn't a part of the
    page's.  The sheet's edges count here.  What a region holds decides all but the last filter, so
    regions that hold the same are worked once (clip_classes).  An id names a region of its page;
    the same row twice is one region.
    """
    regions = save(regions.distinct(), "regions")
    clipped, drawn = save(spatial.clip(glyphs, regions), "clipped"), save(spatial.clip(drawings, regions, by_mode=False), "drawn")
    classes = save(clip_classes(clipped, drawn), "clips")
    first = classes.where("region_id = first_id").select(*REGION_KEYS)
    found = finish(page_entities(clipped.join(first, REGION_KEYS, "left_semi"), REGION_KEYS), drawn.join(first, REGION_KEYS, "left_semi"), sheets, REGION_KEYS, margins=False)
    each = classes.join(found.withColumnRenamed("region_id", "first_id"), ["doc_id", "page", "first_id"]).select(*found.columns)
    r = regions.select(*REGION_KEYS, *(F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")))
    return each.join(r, REGION_KEYS).where(Box.from_array(F.col("text_bbox")).intersects(Box.of("r_"))).select(*found.columns)


def region_summary(regions: DataFrame, sheets: DataFrame, found: DataFrame) -> DataFrame:
    """The region answer: its box, the page's size, the count and the entities in order.  Ids count within their page."""
    n = found.groupBy(*REGION_KEYS).agg(F.count("*").alias("entity_count"), F.array_sort(F.collect_list(F.struct("seq", *[c for c in found.columns if c not in (*REGION_KEYS, "seq")]))).alias("entities"))
    out = regions.distinct().join(sheets, ["doc_id", "page"]).join(n, REGION_KEYS, "left")
    return out.select("region_id", "doc_id", "page", Box.of().normalised().array().alias("region_bbox"), F.col("width").alias("page_width"), F.col("height").alias("page_height"), F.coalesce("entity_count", F.lit(0)).alias("entity_count"), "entities")


def snap(glyphs: DataFrame, drawings: DataFrame, sheets: DataFrame, points: DataFrame) -> DataFrame:
    """Per point (point_id, doc_id, page, x, y, radius, glyph_mode) the nearest dimension about it.

    An id names a point of its page; the same row twice is one point.
    """
    points = points.distinct()
    x, y, r = F.col("x"), F.col("y"), F.col("radius")
    regions = points.select(F.col("point_id").alias("region_id"), "doc_id", "page", (x - r).alias("x0"), (y - r).alias("y0"), (x + r).alias("x1"), (y + r).alias("y1"), "glyph_mode")
    return spatial.nearest_to_point(extract_regions(glyphs, drawings, sheets, regions), points)
