"""Candidates to dimension entities, and which of them are exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.functions import text as tx
from linework.functions.geometry import Box, rounded
from linework.operators.chains import KEYS

EXPLICIT = r"^\s*(\d+(?:\.\d+)?)\s*[Xx×]\s*(\d+(?:\.\d+)?)(.*)$"
LARGEST_SIDE = 5000


def candidates(chains: DataFrame) -> DataFrame:
    """Chains that may be dimensions, with their box's centre."""
    text = tx.strip(F.col("text"))
    keep = (text != "") & ~tx.is_operator(text) & (F.col("grammar_fused") | tx.is_dimension(text))
    x, y = Box.of().center()
    return chains.where(keep).withColumns({"text": text, "cx": x, "cy": y})


def with_pair_columns(df: DataFrame) -> DataFrame:
    """df with the columns that only reconstructed pairs fill."""
    kinds = {"semantic_zone_id": "int", "anchor_x": "double", "anchor_y": "double", "anchor_radius_mm": "double", "reconstructed_operator": "boolean", "confidence": "double"}
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})


def with_written(found: DataFrame) -> DataFrame:
    """found with written: struct(left, right, shown) of a text 'A X B tail' that is a valid pair, else null.

    What is read from a text is a column before it is used again, so each is read once.
    """
    part = lambda i: F.when(F.col("text").rlike("[Xx×]"), F.regexp_extract("text", EXPLICIT, i))
    c = found.withColumns({"w_left": part(1), "w_right": part(2), "w_tail": part(3)})
    c = c.withColumns({"w_a": tx.to_double(F.col("w_left")), "w_b": tx.to_double(F.col("w_right")), "w_rest": tx.strip(F.col("w_tail"))})
    c = c.withColumn("w_shown", tx.plain_number(F.col("w_b")))
    a, b, tail = (F.col(f"w_{n}") for n in ("a", "b", "tail"))
    fits = (a > 0) & (a < LARGEST_SIDE) & (b > 0) & (b < LARGEST_SIDE) & tx.valid_pair(a, b, F.col("w_shown"), F.col("w_rest"))
    c = c.withColumn("w_fits", F.when(a.isNotNull() & b.isNotNull(), F.coalesce(fits, F.lit(False))).otherwise(False))
    gap = F.when(tail.startswith("("), "").otherwise(" ")
    shown = tx.strip(F.concat(tx.short_number(a), F.lit(" X "), tx.short_number(b), gap, tail))
    c = c.withColumn("written", F.when(F.col("w_fits"), F.struct(a.alias("left"), b.alias("right"), shown.alias("shown"))))
    return c.drop(*(f"w_{n}" for n in ("left", "right", "tail", "a", "b", "rest", "shown", "fits")))


def build(found: DataFrame) -> DataFrame:
    """Candidates to entities: a formed pair, a written pair, a number with its tolerance, or plain text.

    tolerance and tolerance_text are the one modifier an entity can have.
    """
    c = with_written(with_pair_columns(found).withColumn("text", tx.strip(F.col("text"))))
    a, b = F.get("values", F.lit(0)), F.get("values", F.lit(1))
    formed = (F.col("entity_type") == "SRC_dimension") & ((F.size(F.coalesce("values", F.array().cast("array<double>"))) < 2) | tx.valid_pair(a, b, tx.plain_number(b), F.lit("")))
    way = F.when(F.coalesce(formed, F.lit(False)), "formed").when(F.col("written").isNotNull(), "written").when(F.col("grammar_fused") & F.col("tolerance_value").isNotNull(), "fused").otherwise("text")
    c = c.withColumn("way", way).withColumns({"own_text": tx.nominal_text(F.col("text")), "own_mark": tx.tolerance_text(F.col("text"))})
    c = c.withColumn("own_number", F.regexp_extract("own_text", r"([\d.]+)", 1))
    c = c.withColumns({"own_nominal": tx.to_double(F.col("own_number")), "own_tolerance": tx.to_double(F.col("own_mark"))})
    is_way = lambda *w: F.col("way").isin(*w)
    nominal = F.when(is_way("fused"), F.col("nominal")).when(is_way("text"), F.col("own_nominal"))
    tolerance = F.when(is_way("fused"), F.col("tolerance_value")).when(is_way("text"), F.col("own_tolerance"))
    c = c.withColumns({"new_nominal": nominal, "new_tolerance": tolerance})
    fits = F.col("new_tolerance").isNotNull() & tx.tolerance_fits(F.col("new_nominal"), F.col("new_tolerance"))
    c = c.withColumn("tolerance", F.when(fits, F.col("new_tolerance")))
    shown = F.concat(F.lit("±"), F.when(is_way("fused"), tx.plain_number(F.col("tolerance"))).otherwise(F.col("own_mark")))
    filled = F.when(F.col("own_text") != "", F.col("own_text")).otherwise(F.col("text"))
    c = c.withColumn("tolerance_text", F.when(F.col("tolerance").isNotNull(), shown))
    nominal_text = F.when(is_way("formed"), F.col("text")).when(is_way("written"), F.col("written.shown")).when(is_way("fused"), F.coalesce("nominal_text", "text")).otherwise(filled)
    display = F.when(is_way("text"), F.concat_ws(" ", filled, F.col("tolerance_text"))).when(is_way("fused"), F.col("text")).otherwise(nominal_text)
    c = c.withColumns({
        "entity_type": F.when(is_way("formed", "written"), "SRC_dimension").otherwise(tx.entity_type(F.col("text"))),
        "display_text": display, "nominal_text": nominal_text, "nominal": F.col("new_nominal"),
        "grammar_rule": F.when(is_way("written"), "EXPLICIT_X_OPERATOR").otherwise(F.col("grammar_rule")),
        "operator": F.when(is_way("formed"), F.col("operator")).when(is_way("written"), "X"),
        "values": F.when(is_way("formed"), F.col("values")).when(is_way("written"), F.array("written.left", "written.right")),
        "reconstructed_operator": F.when(is_way("formed"), F.col("reconstructed_operator")).when(is_way("written"), F.lit(False)),
        "confidence": F.when(is_way("formed"), F.col("confidence")).when(is_way("written"), 1.0),
    })
    dropped = ["written", "way", "own_text", "own_mark", "own_number", "own_nominal", "own_tolerance", "new_nominal", "new_tolerance", "grammar_fused", "tolerance_value", "chain_id", "direction_locked", "text"]
    return c.drop(*dropped)


def sanitize(entities: DataFrame) -> DataFrame:
    """Tolerances that don't fit go; display texts are made anew; a radius starts with R."""
    fits = F.col("tolerance").isNotNull() & tx.tolerance_fits(F.col("nominal"), F.col("tolerance"))
    e = entities.withColumns({"tolerance": F.when(fits, F.col("tolerance")), "tolerance_text": F.when(fits, F.col("tolerance_text"))})
    bare = tx.strip(F.coalesce("nominal_text", F.lit("")))
    radius = (F.col("entity_type") == "radius_dimension") & (bare != "") & ~F.upper(bare).startswith("R")
    e = e.withColumn("nominal_text", F.when(radius, F.concat(F.lit("R"), bare)).otherwise(F.col("nominal_text")))
    text = F.when(F.coalesce("nominal_text", F.lit("")) != "", F.col("nominal_text")).otherwise(F.coalesce("display_text", F.lit("")))
    return e.withColumn("display_text", F.when(F.col("tolerance").isNotNull(), tx.strip(F.concat_ws(" ", "nominal_text", "tolerance_text"))).otherwise(text))


def dedupe_pairs(entities: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The first of the pairs with the same two values on a page's axis; other entities pass."""
    a, b = F.get("values", F.lit(0)), F.get("values", F.lit(1))
    pair = F.coalesce((F.col("entity_type") == "SRC_dimension") & (F.size("values") >= 2), F.lit(False))
    same = Window.partitionBy(*keys, "pair", F.when(F.col("pair"), F.col("dimension_axis")), F.when(F.col("pair"), F.least(a, b)), F.when(F.col("pair"), F.greatest(a, b)), F.when(~F.col("pair"), F.col("seq"))).orderBy("seq")
    return entities.withColumn("pair", pair).withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth", "pair")


def dedupe_best(entities: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Of entities with one text at one place the best read, standing where the first of them stood."""
    place = [*keys, rounded(F.col("cx"), 1), rounded(F.col("cy"), 1), F.col("display_text")]
    rank = F.when(F.col("orientation").isin("horizontal", "vertical"), 5).when(F.col("orientation") == "rotated", 4).when(F.col("orientation").startswith("unresolved"), 2).when(F.col("orientation") == "isolated_glyph", 1).otherwise(0)
    best = Window.partitionBy(*place).orderBy(F.col("tolerance").isNotNull().desc(), rank.desc(), F.col("glyph_count").desc(), F.length("display_text").desc(), "seq")
    e = entities.withColumns({"nth": F.row_number().over(best), "first": F.min("seq").over(Window.partitionBy(*place))})
    return e.where("nth = 1").withColumn("seq", F.col("first")).drop("nth", "first")


def deduplicate(entities: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return dedupe_best(dedupe_pairs(entities, keys), keys)


def scored(entities: DataFrame) -> DataFrame:
    return entities.withColumn("confidence", tx.confidence(F.col("entity_type"), F.col("orientation"), F.col("glyph_count"), F.col("distance"), F.col("reconstructed_operator")))


def exportable(entities: DataFrame, sheets: DataFrame, keys: list[str] = KEYS, margins: bool = True) -> DataFrame:
    """Entities that pass the export rules, with their confidence.  margins: leave out the sheet's edges."""
    e = scored(entities)
    text = tx.strip(F.when(F.coalesce("display_text", F.lit("")) != "", F.col("display_text")).otherwise(F.coalesce("nominal_text", F.lit(""))))
    keep = ~F.col("orientation").startswith("unresolved") & ~tx.is_orphan(text) & ~((F.col("entity_type") == "thickness_dimension") & F.col("nominal").isNull())
    keep &= ~(tx.is_noise(text) & ~F.col("entity_type").isin("SRC_dimension", "radius_dimension", "diameter_dimension"))
    keep &= ~((F.col("entity_type") == "SRC_dimension") & F.coalesce(F.col("distance") > tx.FAR, F.lit(False)))
    keep &= F.col("confidence") >= tx.LEAST_CONFIDENCE
    e = e.where(keep)
    if not margins:
        return e
    sheet_keys = [k for k in ("doc_id", "page") if k in keys]
    return e.join(sheets.select(*sheet_keys, "width", "height"), sheet_keys).where(~tx.in_margin(F.col("cx"), F.col("cy"), F.col("width"), F.col("height"))).drop("width", "height")


def export_records(entities: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The export schema: keys, then 24 fields, with seq for the order."""
    modifier = F.struct(F.lit("tolerance").alias("type"), F.col("tolerance_text").alias("value"), F.lit("bilateral").alias("tolerance_type"), F.col("tolerance").alias("plus"), (-F.col("tolerance")).alias("minus"))
    empty = F.array().cast("array<struct<type:string,value:string,tolerance_type:string,plus:double,minus:double>>")
    lock = F.when(F.col("grammar_rule") == "VERTICAL_DIGIT_FUSION", F.lit(True))
    near = F.when(F.col("near_x0").isNotNull(), Box.of("near_").array())
    return entities.select(
        *keys, "seq", "entity_type", "display_text", "nominal", "nominal_text",
        F.when(F.col("tolerance").isNotNull(), F.array(modifier)).otherwise(empty).alias("modifiers"), tx.limits(F.col("nominal"), F.col("tolerance")).alias("limits"),
        "orientation", "dimension_axis", "axis_bucket", "reading_direction", "grammar_rule", "operator", "values", "semantic_zone_id",
        F.when(F.col("anchor_x").isNotNull(), F.array("anchor_x", "anchor_y")).alias("anchor_center"), "anchor_radius_mm", "reconstructed_operator", "confidence",
        F.lit(None).cast("int").alias("chain_id"), lock.alias("direction_locked"), Box.of().array().alias("text_bbox"), near.alias("nearest_geometry_bbox"), "distance", "glyph_count",
    )
