"""Registered queries of the drawing operators over the standard tables, with their SQL.

The events table gives the sheets: 50 annotations a page in 5 columns and 10 rows, a glyph per
character, a drawing under every third annotation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linework.functions import text as tx
from linework.functions.geometry import Box, distance, envelope, page_height, screen_rect_to_sheet, sheet_to_screen
from linework.operators import chains as ch
from linework.operators import entities as en
from linework.operators import grammar, matching, registry, spatial
from linework.plans import extract
from linework.sources.scratch import save
from linework.sources.sheets import flatten_pages
from linework.streaming.ingest import latest_per_client

WIDTH, HEIGHT = 850.0, 800.0
#: event_id % 8 gives an annotation's form, in both dialects.
_FORM = """case event_id%8 when 0 then concat(a,'.',t) when 1 then concat(a,'±0.',t) when 2 then concat(a,'X',b) when 3 then concat('R',b)
 when 4 then concat(b,'(REF)') when 5 then concat(a,'') when 6 then concat(b,'THK') else concat(a,'±',b) end"""
_PLACE = "event_id, cast(floor(event_id/500) as bigint) doc_id, cast(floor((event_id%500)/50) as int)+1 page, cast(event_id%50 as int) slot, event_id%37+1 b, event_id%9+1 t"
_AT = "cast(40 as double)+160*(slot%5) ax, cast(60 as double)+72*cast(floor(slot/5) as int) ay"


#: The crowded sheets: 1,000 annotations a page at places that many share, some of them with the same characters.
_CROWD = "event_id, cast(floor(event_id/1000) as bigint) doc_id, 1 page, cast(event_id%50 as int) slot, event_id%37+1 b, event_id%9+1 t"
_CROWD_AT = "cast(6*(event_id*37%131) as double) ax, cast(9*(event_id*11%83) as double) ay"
#: Bare numbers of two digits on 40 lines of a crowded page.
_NUMBERS = "event_id, cast(floor(event_id/1000) as bigint) doc_id, 1 page, cast(10+event_id*7%41 as string) text, cast(event_id*613%1009 as double) ax, cast(20*(event_id*11%40) as double) ay"
#: Every third annotation of the crowded sheets is a lone THK, the others are bare numbers.
_LONE = "case event_id%3 when 0 then 'THK' else cast(a as string) end"
#: Numbers with a tolerance in one token, and what only looks like that.
_INLINE = "case event_id%5 when 0 then concat(a,'±0.',t) when 1 then concat(' ',b,' ± ',t,' ') when 2 then concat(a,'±') when 3 then concat('R',a,'±',t) else concat(b,'.5±',b) end"

#: The mixed sheets: every second annotation on is upright, of two sizes, or struck twice in a font of its own.
_MIXED = """event_id*32+i+copy seq, substr(text, i, 1) char, case event_id%4 when 3 then 'F2' else 'F1' end font, cast(case when event_id%4=2 and i%2=0 then 14 else 10 end as double) size,
 ax + case event_id%4 when 1 then 0 when 2 then 4*(i-1) else 6*(i-1) end x0, ay - case event_id%4 when 1 then 10*(i-1) else 0 end y0"""
#: Tolerance marks beside every third annotation: above it where that is upright, else to its right.
_MARKS = """event_id+1000000000 mseq, concat('±', event_id%5) mtext, cx + case event_id%2 when 1 then 3 else 20 end mx, cy - case event_id%2 when 1 then 20 else 4 end my,
 case when event_id%15=0 then null when event_id%2=1 then 'unresolved_vertical_fragment' else 'rotated' end mo"""
#: How the annotations read then.
_READING = "case when event_id%10=5 then null when event_id%2=1 then 'vertical' when event_id%6=0 then 'unresolved_horizontal_fragment' else 'horizontal' end"


#: Events for each shuffle partition, and the shuffled bytes that Spark may put together for a task: sorted rows take some
#: twenty times as much memory.
EVENTS_A_PART, TASK_BYTES = 50_000, 8 << 20
#: Bytecodes of a method beyond which the JVM doesn't compile it: Spark then projects in parts.
METHOD_BYTES = 8000


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events; the session's shuffle partitions are raised where they would get over EVENTS_A_PART each, and what a
    task is given at once is lowered to TASK_BYTES where that stands at Spark's 64 MB, as are its longest methods to
    METHOD_BYTES where they stand at 65,535."""
    e, n, most = spark.read.parquet(f"{d}/events.parquet"), "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    longest = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(n, str(max(int(spark.conf.get(n)), -(-e.count() // EVENTS_A_PART))))
    if spark.conf.get(most) in ("64MB", "67108864b", str(64 << 20)):
        spark.conf.set(most, str(TASK_BYTES))
    if spark.conf.get(longest, "65535") == "65535":
        spark.conf.set(longest, str(METHOD_BYTES))
    return e


def annotations(spark: SparkSession, d: str, least: int = 0) -> DataFrame:
    """One row per event; least is added to its number a (10 leaves no single digits)."""
    e = _events(spark, d).selectExpr(*_split(_PLACE), f"cast(floor(value) as bigint)+{least} a", "event_type", "user_id", "ts")
    return e.selectExpr("*", *_split(_AT), f"{_FORM} text")


def _split(columns: str) -> list[str]:
    return columns.split(", ")


def _columns(text: str) -> list[str]:
    """Expressions of a select list, cut at the commas outside brackets."""
    out, depth = [""], 0
    for c in text.replace("\n", " "):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def glyphs(annot: DataFrame) -> DataFrame:
    i = F.col("i")
    g = annot.select("doc_id", "page", "event_id", "ax", "ay", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i"))
    return g.select("doc_id", "page", (F.col("event_id") * 32 + i).alias("seq"), F.substring("text", i, F.lit(1)).alias("char"), (F.col("ax") + 6 * (i - 1)).alias("x0"), F.col("ay").alias("y0"), (F.col("ax") + 6 * (i - 1) + 5).alias("x1"), (F.col("ay") + 9).alias("y1"), F.lit("F1").alias("font"), F.lit(10.0).alias("size"))


def mixed_glyphs(annot: DataFrame) -> DataFrame:
    copies = F.explode(F.when(F.col("event_id") % 4 == 3, F.array(F.lit(0), F.lit(16))).otherwise(F.array(F.lit(0))))
    g = annot.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("text")))).withColumn("copy", copies)
    return g.selectExpr("doc_id", "page", *_columns(_MIXED)).select("*", (F.col("x0") + 5).alias("x1"), (F.col("y0") + 9).alias("y1"))


def drawings(annot: DataFrame) -> DataFrame:
    return annot.where("event_id % 3 = 0").select("doc_id", "page", F.col("event_id").alias("seq"), (F.col("ax") - 4).alias("x0"), (F.col("ay") + 12).alias("y0"), (F.col("ax") + 40).alias("x1"), (F.col("ay") + 12).alias("y1"))


def sheets(annot: DataFrame) -> DataFrame:
    return annot.select("doc_id", "page").distinct().withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT)})


def crowded(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).selectExpr(*_split(_CROWD), "cast(floor(value) as bigint) a")
    return e.selectExpr("*", *_split(_CROWD_AT), f"{_FORM} text")


def regions(annot: DataFrame) -> DataFrame:
    """Three a page, with the same ids on every page: one by overlap, one by centres, and one that holds what the first does."""
    mode = F.when(F.col("event_id") % 2 == 0, "center").otherwise("intersects")
    twice = F.explode(F.when(F.col("slot") == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    r = annot.where("slot in (7, 28)").withColumn("wider", twice)
    return r.select("doc_id", "page", (F.col("slot") + F.col("wider")).cast("long").alias("region_id"), (F.col("ax") - 42 - F.col("wider")).alias("x0"), (F.col("ay") - 30).alias("y0"), (F.col("ax") + 182).alias("x1"), (F.col("ay") + 81).alias("y1"), mode.alias("glyph_mode"))


def points(annot: DataFrame) -> DataFrame:
    """Five a page, with the same ids on every page."""
    return annot.where("slot % 10 = 3").select(F.col("slot").cast("long").alias("point_id"), "doc_id", "page", (F.col("ax") + 11).alias("x"), (F.col("ay") + 15).alias("y"), F.lit(24.0).alias("radius"), F.lit("intersects").alias("glyph_mode"))


def candidate_rows(annot: DataFrame) -> DataFrame:
    """Annotations as candidates, each its whole text."""
    null = lambda t: F.lit(None).cast(t)
    n = F.length("text")
    return annot.select(
        "doc_id", "page", F.col("event_id").alias("seq"), "text", F.col("ax").alias("x0"), F.col("ay").alias("y0"), (F.col("ax") + 6 * n - 1).alias("x1"), (F.col("ay") + 9).alias("y1"), (F.col("ax") + (6 * n - 1) / 2).alias("cx"), (F.col("ay") + 4.5).alias("cy"), n.alias("glyph_count"),
        F.lit("horizontal").alias("orientation"), F.lit("horizontal").alias("dimension_axis"), F.bround(F.col("ay") / 4.5, 0).cast("int").alias("axis_bucket"), F.lit("left_to_right").alias("reading_direction"), F.lit(False).alias("grammar_fused"), F.lit("CHAIN_STRING").alias("grammar_rule"),
        null("double").alias("nominal"), null("string").alias("nominal_text"), null("double").alias("tolerance_value"), null("string").alias("entity_type"), null("string").alias("operator"), null("array<double>").alias("values"),
        null("int").alias("chain_id"), null("boolean").alias("direction_locked"),
    )


def _entities(rows: DataFrame) -> DataFrame:
    """Candidates as entities; saved, as the page plans do."""
    return save(en.sanitize(save(en.build(rows), "built")), "entities")


def _pieces(annot: DataFrame) -> DataFrame:
    """Texts and parts of them."""
    parts = F.posexplode(F.array(F.col("text"), F.expr("right(text, 2)"), F.concat(F.lit("±"), "b"), F.lit("+"), F.concat(F.lit("0"), "b"))).alias("nth", "piece")
    return annot.select("event_id", parts)


def entity_types(spark, d):
    return annotations(spark, d).select("event_id", "text", tx.entity_type(F.col("text")).alias("entity_type"))


def lexemes(spark, d):
    p = F.col("piece")
    flags = {"is_tolerance": tx.is_tolerance_modifier(p), "is_operator": tx.is_operator(p), "is_nominal": tx.is_nominal(p), "is_dimension": tx.is_dimension(p), "is_number": tx.is_number_token(p), "lexeme": tx.lexeme(p), "mostly_digits": tx.mostly_digits(p)}
    return _pieces(annotations(spark, d)).withColumns(flags)


def noise(spark, d):
    p = F.col("piece")
    return _pieces(annotations(spark, d)).withColumns({"noise": tx.is_noise(p), "orphan": tx.is_orphan(p)})


def numbers(spark, d):
    t = F.col("text")
    n, tol = tx.parse_nominal(t), tx.parse_tolerance(t)
    return annotations(spark, d).select("event_id", n.alias("nominal"), tx.nominal_text(t).alias("nominal_text"), tol.alias("tolerance"), tx.tolerance_text(t).alias("tolerance_text"), tx.limits(n, tol)["min"].alias("least"), tx.limits(n, tol)["max"].alias("most"), tx.short_number(n).alias("shown"))


def tolerances(spark, d):
    a = annotations(spark, d).select("event_id", F.col("a").cast("double").alias("nominal"), (F.col("b") / 4).alias("tolerance"))
    return a.withColumns({"valid": tx.valid_tolerance(F.col("tolerance")), "fits": tx.tolerance_fits(F.col("nominal"), F.col("tolerance"))})


def pairs(spark, d):
    a, b = (F.col("a") % 20).cast("double"), F.col("b").cast("double") / 2
    tail = F.when(F.col("t") == 1, " nos").when(F.col("t") == 2, "°").when(F.col("t") == 3, " (REF)").otherwise("")
    rows = annotations(spark, d).select("event_id", a.alias("left"), b.alias("right"), tail.alias("tail"))
    return rows.withColumns({"plausible": tx.plausible_pair(F.col("left"), F.col("right"), F.col("tail")), "valid": tx.valid_pair(F.col("left"), F.col("right"), tx.plain_number(F.col("right")), F.col("tail"))})


def margins(spark, d):
    return annotations(spark, d).select("event_id", tx.in_margin(F.col("ax"), F.col("ay"), F.lit(WIDTH), F.lit(HEIGHT)).alias("in_margin"))


def confidences(spark, d):
    kind = F.when(F.col("slot") % 3 == 0, "SRC_dimension").otherwise("linear_dimension")
    orientation = F.when(F.col("slot") % 7 == 0, "isolated_glyph").when(F.col("slot") % 11 == 0, "unresolved_vertical_fragment").otherwise("horizontal")
    a = annotations(spark, d)
    return a.select("event_id", tx.confidence(kind, orientation, F.col("t").cast("int") - 1, F.col("b").cast("double"), F.col("slot") % 2 == 0).alias("confidence"))


def envelopes(spark, d):
    return glyphs(annotations(spark, d)).groupBy("doc_id", "page").agg(*envelope(), F.count("*").alias("n"))


def coordinates(spark, d):
    turn = F.array(*(F.lit(x) for x in (0.0, 2.0, 4.0, 0.0, 3.0, 5.0)))
    g = candidate_rows(annotations(spark, d))
    screen = sheet_to_screen(Box.of(), turn, F.lit(HEIGHT))
    back = screen_rect_to_sheet(Box(F.col("s.x"), F.col("s.y"), F.col("s.x") + F.col("s.w"), F.col("s.y") + F.col("s.h")), turn, F.lit(HEIGHT))
    up = Box.of().flipped(F.lit(HEIGHT))
    return g.withColumn("s", screen).select("seq", "s.x", "s.y", "s.w", "s.h", up.y0.alias("up_y0"), up.y1.alias("up_y1"), *(c.alias(f"back_{n}") for n, c in back.columns().items()))


def clipped_glyphs(spark, d):
    a = annotations(spark, d)
    return spatial.clip(glyphs(a), regions(a)).groupBy("doc_id", "page", "region_id").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def point_distances(spark, d):
    a = annotations(spark, d)
    both = candidate_rows(a).drop("radius").join(points(a).select("point_id", "doc_id", "page", "x", "y"), ["doc_id", "page"])
    return both.groupBy("doc_id", "page", "point_id").agg(F.min(Box.of().to_point(F.col("x"), F.col("y"))).alias("nearest"), F.min(distance(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))).alias("centre"))


def _metric_glyphs(spark, d):
    return ch.with_thresholds(ch.with_metrics(glyphs(annotations(spark, d))))


def thresholds(spark, d):
    return ch.thresholds(ch.with_metrics(glyphs(annotations(spark, d))))


def neighbors(spark, d):
    return ch.neighbor_counts(_metric_glyphs(spark, d)).select("seq", "h_near", "v_near")


def axes(spark, d):
    return ch.with_axes(ch.neighbor_counts(_metric_glyphs(spark, d))).select("seq", "dimension_axis", "axis_bucket")


def components(spark, d):
    return ch.components(ch.with_axes(ch.neighbor_counts(_metric_glyphs(spark, d)))).select("seq", "component")


def _mixed(spark, d):
    return ch.with_axes(ch.neighbor_counts(ch.with_thresholds(ch.with_metrics(mixed_glyphs(annotations(spark, d))))))


def mixed_axes(spark, d):
    """Two fonts, two sizes, upright rows and glyphs struck twice."""
    lone = ch.singleton_kind(F.col("dimension_axis"), F.col("h_near"))
    return _mixed(spark, d).select("seq", "h_near", "v_near", "dimension_axis", "axis_bucket", lone.alias("lone"), tx.reading_direction(F.col("dimension_axis")).alias("reading"))


def mixed_components(spark, d):
    return ch.components(_mixed(spark, d)).select("seq", "component")


def splits(spark, d):
    """Rows of digits with a wide gap after the fifth and 14 in the longest: chunks and slices."""
    n = F.col("event_id") % 6 * 4
    a = annotations(spark, d).withColumn("i", F.explode(F.sequence(F.lit(1), n.cast("int") + 1)))
    g = a.select("doc_id", "page", (F.col("event_id") * 32 + F.col("i")).alias("seq"), F.lit("7").alias("char"), (F.col("i") * 6.0 + F.when(F.col("i") > 5, 40.0).otherwise(0.0)).alias("along"), F.lit("horizontal").alias("dimension_axis"), F.lit(1).alias("axis_bucket"), F.col("event_id").alias("component"))
    return ch.split_components(g).select("seq", "chunk", "piece")


def _ordered(annot: DataFrame) -> DataFrame:
    g = glyphs(annot).withColumn("event_id", F.floor(F.col("seq") / 32))
    return g.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct(F.col("x0").alias("along"), "seq", "char"))).alias("g"), F.max(F.col("char").isin(*tx.OPERATORS)).alias("has_operator"))


def tokens(spark, d):
    return _ordered(annotations(spark, d)).select("event_id", F.posexplode(grammar.tokens(F.col("g"))).alias("nth", "token")).select("event_id", "nth", "token.text", "token.type")


def parentheses(spark, d):
    found = grammar.merge_parentheses(grammar.tokens(F.col("g")))
    return _ordered(annotations(spark, d)).select("event_id", F.posexplode(found).alias("nth", "token")).select("event_id", "nth", "token.text")


def grammar_rules(spark, d):
    found = _ordered(annotations(spark, d)).select("event_id", F.posexplode(grammar.dimensions(F.col("g"), F.col("has_operator"))).alias("nth", "x"))
    return found.select("event_id", "nth", "x.text", "x.grammar_rule", "x.grammar_fused", "x.nominal", "x.tolerance_value", F.get("x.values", F.lit(0)).alias("left"), F.get("x.values", F.lit(1)).alias("right"))


def entities(spark, d):
    e = _entities(candidate_rows(annotations(spark, d)))
    return e.select("seq", "entity_type", "display_text", "nominal", "nominal_text", "tolerance", "grammar_rule", F.get("values", F.lit(0)).alias("left"), F.get("values", F.lit(1)).alias("right"))


def dedupe_pairs(spark, d):
    return en.dedupe_pairs(_entities(candidate_rows(annotations(spark, d)))).select("seq", "display_text")


def dedupe_best(spark, d):
    """Annotations moved onto each other: five places a page."""
    e = _entities(candidate_rows(annotations(spark, d))).withColumns({"cx": F.col("x0"), "cy": F.lit(1.0), "display_text": F.col("entity_type"), "glyph_count": F.col("glyph_count").cast("int")})
    return en.dedupe_best(e).select("doc_id", "page", "seq", "display_text", "glyph_count", "nominal_text")


def nearest_drawings(spark, d):
    a = annotations(spark, d)
    return spatial.nearest_drawing(candidate_rows(a), drawings(a)).select("seq", "distance", "near_x0", "near_y0", "near_x1", "near_y1")


def _near_modifiers(annot: DataFrame) -> DataFrame:
    """A tolerance mark to the right of every second annotation."""
    c = candidate_rows(annot.where("event_id % 2 = 0"))
    return c.select("doc_id", "page", (F.col("seq") + 1_000_000_000).alias("seq"), F.concat(F.lit("±"), F.col("seq") % 5).alias("text"), *((F.col(x) + 20).alias(x) for x in ("x0", "x1", "cx")), "y0", "y1", "cy", "glyph_count", "orientation", "dimension_axis")


def nearest_parents(spark, d):
    a = annotations(spark, d)
    return matching.nearest_parent(_near_modifiers(a), _entities(candidate_rows(a))).select("mseq", "seq")


def mixed_parents(spark, d):
    """Marks beside upright and level numbers, of several orientations and none."""
    axis = F.expr("case event_id%2 when 1 then 'vertical' else 'horizontal' end")
    a = annotations(spark, d)
    c = candidate_rows(a).withColumn("event_id", F.col("seq"))
    marks = c.where("event_id % 3 = 0").selectExpr("doc_id", "page", "event_id", *_columns(_MARKS)).withColumn("dimension_axis", axis)
    marks = marks.select("doc_id", "page", F.col("mseq").alias("seq"), F.col("mtext").alias("text"), F.col("mx").alias("cx"), F.col("my").alias("cy"), F.col("mo").alias("orientation"), "dimension_axis")
    c = c.withColumns({"dimension_axis": axis, "orientation": F.expr(_READING)}).drop("event_id")
    return matching.nearest_parent(marks, _entities(c)).select("mseq", "seq")


def attached_modifiers(spark, d):
    a = annotations(spark, d)
    return matching.attach_modifiers(_near_modifiers(a), _entities(candidate_rows(a))).select("seq", "display_text", "tolerance", "glyph_count", "x1", "cx")


def formed_pairs(spark, d):
    """Two bare numbers with room for an X, one couple in every 160 units."""
    a = annotations(spark, d)
    c = candidate_rows(a.withColumn("text", F.col("b").cast("string")))
    right = candidate_rows(a.withColumn("text", (F.col("t") + 11).cast("string")).withColumn("ax", F.col("ax") + 40)).withColumn("seq", F.col("seq") + 1_000_000_000)
    found = matching.form_pairs(en.with_pair_columns(c.unionByName(right)))
    return found.where("entity_type = 'SRC_dimension'").select("doc_id", "page", "text", "x0", "x1", "confidence")


def bound_thickness(spark, d):
    """A lone THK beside each annotation of a bare number."""
    a = annotations(spark, d)
    thk = candidate_rows(a.where("event_id % 8 = 5").withColumn("text", F.lit("THK")).withColumn("ax", F.col("ax") + 12)).withColumn("seq", F.col("seq") + 1_000_000_000)
    found = matching.bind_thickness(_entities(candidate_rows(a).unionByName(thk)))
    return found.where("entity_type = 'thickness_dimension'").select("seq", "display_text", "x0", "x1")


def merged_references(spark, d):
    """A lone (REF) beside each annotation of a bare number; what is left of each page."""
    a = annotations(spark, d)
    ref = candidate_rows(a.where("event_id % 8 = 5").withColumn("text", F.lit("(REF)")).withColumn("ax", F.col("ax") + 18)).withColumn("seq", F.col("seq") + 1_000_000_000)
    found = matching.merge_references(_entities(candidate_rows(a).unionByName(ref)))
    return found.select("doc_id", "page", "display_text", "nominal", "entity_type", "x0", "x1")


def stacked_digits(spark, d):
    """Three digits above each other in each annotation's place, far from the next."""
    a = annotations(spark, d)
    null = lambda t: F.lit(None).cast(t)
    digit = F.expr("cast((event_id * 7 + i * 3) % 10 as string)")
    e = a.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(
        F.col("event_id").alias("doc_id"), "page", F.col("i").cast("long").alias("seq"), digit.alias("display_text"), F.col("ax").alias("x0"), (F.col("ay") + 12 * F.col("i")).alias("y0"), (F.col("ax") + 5).alias("x1"), (F.col("ay") + 12 * F.col("i") + 9).alias("y1"),
        (F.col("ax") + 2.5).alias("cx"), (F.col("ay") + 12 * F.col("i") + 4.5).alias("cy"), F.lit(1).alias("glyph_count"), F.lit("unresolved_vertical_fragment").alias("orientation"), F.lit("vertical").alias("dimension_axis"), F.lit(9).alias("axis_bucket"),
        null("string").alias("entity_type"), null("double").alias("nominal"), null("string").alias("nominal_text"), null("string").alias("reading_direction"), null("string").alias("grammar_rule"),
    )
    return matching.fuse_stacked_digits(e).select("doc_id", "display_text", "nominal", "y0", "y1", "glyph_count")


def exported(spark, d):
    a = annotations(spark, d)
    near = save(spatial.nearest_drawing(_entities(candidate_rows(a)), drawings(a)), "placed")
    return en.exportable(near, sheets(a)).select("seq", "display_text", "confidence")


def inline_tolerances(spark, d):
    token = F.struct(F.col("text").alias("text"), F.array("event_id").alias("ids"))
    a = annotations(spark, d).withColumn("text", F.expr(_INLINE))
    return a.withColumn("x", grammar.inline_tolerance(token)).select("event_id", "text", F.col("x.text").alias("found"), "x.grammar_rule", "x.nominal", "x.tolerance_value")


def page_heights(spark, d):
    """Heights of view boxes that begin anywhere, and a point's way to the screen and back over them."""
    box = F.array(*(F.col(c).cast("double") for c in ("ax", "t", "b")), F.col("ay") + F.col("a"))
    a = annotations(spark, d).withColumn("height", page_height(box))
    up = Box(F.col("ax"), F.col("ay"), F.col("ax") + 9, F.col("ay") + 5).flipped(F.col("height"))
    return a.select("event_id", "height", up.y0.alias("y0"), up.y1.alias("y1"))


def crowded_order(spark, d):
    """Each annotation of the crowded sheets a group: what is kept in order, and the glyphs that nobody used."""
    g = glyphs(crowded(spark, d)).withColumns({"cx": F.col("x0") + 2.5, "cy": F.col("y0") + 4.5, "h_near": F.lit(1).cast("long"), "along": F.col("x0")})
    own = F.struct("along", "seq", "char", "x0", "y0", "x1", "y1", "cx", "cy", "h_near")
    groups = g.groupBy("doc_id", "page", F.floor(F.col("seq") / 32).alias("event_id")).agg(F.array_sort(F.collect_list(own)).alias("glyphs"), F.max(F.col("char").isin(*tx.OPERATORS)).alias("has_operator"), F.min("seq").alias("first_seq"))
    zero = {c: F.lit(0) for c in ("axis_bucket", "chunk", "piece")}
    groups = groups.withColumns({"dimension_axis": F.lit("horizontal"), "component": F.col("first_seq"), **zero, "found": grammar.dimensions(F.col("glyphs"), F.col("has_operator"))}).drop("event_id")
    kept = registry.chains(save(registry.ordered(groups), "groups"))
    return kept.select("doc_id", "chain_id", "text", "x0", "y0", "glyph_count")


def crowded_pairs(spark, d):
    """Bare numbers close to each other on the lines of a crowded page."""
    e = _events(spark, d).selectExpr(*_split(_NUMBERS))
    c = candidate_rows(e.withColumn("text", F.col("text")))
    found = matching.form_pairs(en.with_pair_columns(c)).where("entity_type = 'SRC_dimension'")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return found.select("doc_id", order.alias("nth"), "text", "x0", "x1", "y0")


def crowded_matches(spark, d):
    """Lone THK marks among numbers of the crowded sheets: each in order takes its nearest free one."""
    a = crowded(spark, d).withColumn("text", F.expr(_LONE))
    found = matching.bind_thickness(_entities(candidate_rows(a)))
    return found.where("entity_type = 'thickness_dimension'").select("seq", "display_text", "x0", "x1", "y0", "y1")


def flattened_pages(spark, d):
    """Nested pages back to glyphs."""
    g = glyphs(annotations(spark, d))
    char = F.struct(F.col("char").alias("c"), Box.of().array().alias("bbox"))
    blank = F.array(F.struct(F.lit(" ").alias("c"), F.array(*(F.lit(0.0),) * 4).alias("bbox")))
    chars = F.transform(F.array_sort(F.collect_list(F.struct("seq", char.alias("ch")))), lambda x: x["ch"])
    page = g.groupBy("doc_id", "page").agg(chars.alias("chars"))
    span = lambda c: F.array(F.struct(F.array(F.struct(F.lit("F1").alias("font"), F.lit(10.0).alias("size"), c.alias("chars"))).alias("spans")))
    blocks = F.array(F.struct(F.lit(1).alias("type"), span(F.col("chars")).alias("lines")), F.struct(F.lit(0).alias("type"), span(F.concat(blank, F.col("chars"))).alias("lines")))
    flat = flatten_pages(page.select("doc_id", "page", blocks.alias("blocks")))
    return flat.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum("x0").alias("x"), F.count_distinct("seq").alias("places"), F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("seq", "char"))), lambda x: x["char"])).alias("text"))


def bursts(spark, d):
    """The last event of each burst of a user's: pauses over an hour end one."""
    e = annotations(spark, d).select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("request_id"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    return latest_per_client(e, "1 hour")


def full_page(spark, d):
    """The whole document plan."""
    a = annotations(spark, d, 10)
    found = extract.extract_document(glyphs(a), drawings(a), sheets(a))
    return found.select("doc_id", "page", "display_text", "entity_type", "nominal", F.get("modifiers", F.lit(0))["plus"].alias("tolerance"), "limits.min", "limits.max", "grammar_rule", "orientation", "glyph_count", F.round("distance", 6).alias("distance"), "confidence", F.get("text_bbox", F.lit(0)).alias("x0"))


def page_chains(spark, d):
    """All chains of every page, leftovers too."""
    a = annotations(spark, d)
    return extract.page_chains(glyphs(a)).select("doc_id", "page", "seq", "text", "orientation", "grammar_rule", "glyph_count", "x0", "y0")


def page_summary(spark, d):
    """How many dimensions of each kind a document has, and the widest limits."""
    return full_page(spark, d).groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"), F.sum("tolerance").alias("tolerances"), F.max("max").alias("most"))


def region_extract(spark, d):
    a = annotations(spark, d, 10)
    found = extract.extract_regions(glyphs(a), drawings(a), sheets(a), regions(a))
    texts = F.concat_ws("|", F.transform("entities", lambda e: e["display_text"]))
    box = [F.get("region_bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return extract.region_summary(regions(a), sheets(a), found).select("region_id", "doc_id", "page", *box, "page_width", "page_height", F.col("entity_count").cast("long").alias("entity_count"), texts.alias("texts"))


def snap(spark, d):
    a = annotations(spark, d, 10)
    found = extract.snap(glyphs(a), drawings(a), sheets(a), points(a))
    return found.select("point_id", "doc_id", "page", F.col("candidate_count").cast("long").alias("candidate_count"), "selected.display_text", "snap_distance")


QUERIES = {f"q_{f.__name__}": f for f in (
    entity_types, lexemes, noise, numbers, tolerances, pairs, margins, confidences, envelopes, coordinates, clipped_glyphs, point_distances, thresholds, neighbors, axes, components, mixed_axes, mixed_components, splits, tokens, parentheses, grammar_rules, entities,
    dedupe_pairs, dedupe_best, nearest_drawings, nearest_parents, mixed_parents, attached_modifiers, formed_pairs, bound_thickness, merged_references, stacked_digits, inline_tolerances, page_heights, crowded_order, crowded_pairs, crowded_matches, exported, flattened_pages, bursts, full_page, page_chains, page_summary, region_extract, snap,
)}
