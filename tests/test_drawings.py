"""The drawing operators: truth tables, small pages with known results, and the SQL oracles."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linework.functions import geometry
from linework.functions import text as tx
from linework.operators import chains, entities, grammar, matching, registry, spatial
from linework.plans import extract, oracles, queries
from linework.sources import sheets
from linework.streaming import ingest

DATA = "/root/testdata/sf0.001"


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_pairs(spark):
    rows = [(17.0, 28.0, "28", ""), (20.0, 45.0, "45", "°"), (12.0, 0.5, "0.5", ""), (11.0, 17.0, "17", ""), (12.0, 2.0, "2nos", ""), (2.0, 10.0, "Ø10", ""), (2.0, 1.0, "1", ""), (3.0, 4.0, "4", ""), (12.0, 6.0, "6", "(REF)")]
    got = values(spark, rows, "l double, r double, rt string, tail string", tx.valid_pair(F.col("l"), F.col("r"), F.col("rt"), F.col("tail")))
    assert [x for (x,) in got] == [True] * 4 + [False] * 5


def test_texts(spark):
    rows = [("R10",), ("ø10",), ("45°",), ("2.5THK",), ("78.7(REF)",), ("12.25",), ("  7 ",), ("1.2.3",), ("±0.2",), ("",), (None,)]
    t = F.col("t")
    got = values(spark, rows, "t string", tx.entity_type(t), tx.is_noise(t), tx.parse_nominal(t), tx.is_nominal(tx.strip(t)))
    assert [g[0].split("_")[0] for g in got] == ["radius", "diameter", "angular", "thickness", "reference", "linear", "linear", "linear", "linear", "linear", "linear"]
    assert [g[1] for g in got] == [False, False, False, False, False, True, False, False, False, True, True]
    assert [g[2] for g in got] == [10, 10, 45, 2.5, 78.7, 12.25, 7, None, None, None, None]
    assert [g[3] for g in got][:9] == [True, True, True, True, True, True, True, True, False]


def test_tolerances(spark):
    rows = [(50.7, 0.2, True), (52.0, 99.0, False), (10.0, 0.0, True), (5.0, 3.0, False), (None, 1.2, True), (100.0, 7.0, False), (4.0, 2.0, True)]
    got = values(spark, rows, "n double, t double, want boolean", tx.tolerance_fits(F.col("n"), F.col("t")), "want")
    assert all(a == b for a, b in got)


def word(doc, text, x=100.0, y=200.0, font="F1", pitch=6.0, seq=0):
    return [(doc, 1, seq + i, c, float(x + pitch * i), y, x + pitch * i + 5, y + 9, font, 10.0) for i, c in enumerate(text)]


GLYPH = "doc_id string, page int, seq long, char string, x0 double, y0 double, x1 double, y1 double, font string, size double"
BOX = "doc_id string, page int, seq long, x0 double, y0 double, x1 double, y1 double"
CASES = {
    "M1": (word("M1", "50.7±0.2"), ["50.7 ±0.2"]), "M2": (word("M2", "52.0±99"), ["99"]), "M3": (word("M3", "12X28"), ["12 X 28"]), "M4": (word("M4", "12X0.5"), ["12 X 0.5"]),
    "M5": (word("M5", "17") + word("M5", "28", x=131, seq=10), ["17 X 28"]), "M6": (word("M6", "3X4"), ["3X4"]), "M7": (word("M7", "R10"), ["R10"]), "M7d": (word("M7d", "Ø10"), ["10"]),
    "M8": (word("M8", "10") + word("M8", "THK", x=112, font="F2", seq=10), ["10 THK"]), "M9": (word("M9", "3THK"), []), "M9b": (word("M9b", "2.5THK"), ["2.5THK"]), "M10": (word("M10", "78.7(REF)"), ["78.7(REF)"]), "M12": (word("M12", "12.25"), []),
    "M13": (word("M13", "50.7±0.2"), ["50.7 ±0.2"]), "M15": (word("M15", "123", y=720.0), []), "M16": (word("M16", "123") + word("M16", "123", font="F2", seq=10), ["123"]), "T": (word("T", "12−0.5"), ["12 ±0.5"]),
    "X4a": (word("X4a", "12X2nos"), ["12 X 2"]), "X4b": (word("X4b", "12/05"), ["12 X 05"]), "X4c": (word("X4c", "4XR10"), ["4 X 10"]), "X7": (word("X7", "R5±0.2"), ["5 ±0.2"]), "X8a": (word("X8a", "12±0.20"), ["12 ±0.2"]), "X8b": (word("X8b", "30±1"), ["30 ±1.0"]),
    "X11": (word("X11", "7") + word("X11", "THK", x=112, font="F2", seq=10), []), "X20": (word("X20", "١٢٫٥"), []),
}


@pytest.fixture(scope="module")
def pages(spark):
    glyphs = spark.createDataFrame([g for rows, _ in CASES.values() for g in rows], GLYPH)
    drawn = []
    for doc, (rows, _) in CASES.items():
        x = (min(r[4] for r in rows) + max(r[6] for r in rows)) / 2
        drawn += [(doc, 1, 0, x - 10, rows[0][5] + 12, x + 10, rows[0][5] + 12)] if doc != "M13" else []
    boxes = spark.createDataFrame(drawn, BOX)
    size = spark.createDataFrame([(d, 1, 850.0, 800.0) for d in CASES], "doc_id string, page int, width double, height double")
    return glyphs, boxes, size


def test_small_pages(pages):
    found = extract.extract_document(*pages).collect()
    assert {d: sorted(r["display_text"] for r in found if r["doc_id"] == d) for d in CASES} == {d: w for d, (_, w) in CASES.items()}
    one = next(r for r in found if r["doc_id"] == "M1")
    assert (one["entity_type"], one["nominal"], one["grammar_rule"], one["glyph_count"], one["confidence"]) == ("linear_dimension", 50.7, "NUMBER_OPERATOR_NUMBER", 8, 1.0)
    assert (one["limits"]["min"], one["limits"]["max"]) == (50.5, 50.9) and one["modifiers"][0]["value"] == "±0.2"
    far = next(r for r in found if r["doc_id"] == "M13")
    assert far["distance"] == math.inf and far["confidence"] == 0.35


def test_traps_of_single_rules(spark):
    token = F.struct(F.col("t").alias("text"), F.array(F.lit(1).cast("long")).alias("ids"))
    got = spark.createDataFrame([("12.5±0.3",), (" 8 ± 1 ",), ("5±9",), ("12±",), ("x",)], "t string").select(grammar.inline_tolerance(token).alias("x")).select("x.text", "x.grammar_rule", "x.nominal", "x.tolerance_value").collect()
    assert [tuple(r) for r in got] == [("12.5 ±0.3", "INLINE_TOLERANCE", 12.5, 0.3), ("8 ±1", "INLINE_TOLERANCE", 8.0, 1.0), (None,) * 4, (None,) * 4, (None,) * 4]
    rows = [(5.0, 4.0, "4", "°", None, True), (5.0, 4.0, "4", "°", 4, False), (5.0, 4.0, "4", "°", 5, True), (5.5, 4.0, "4", "", 4, True), (12.0, 4.0, "4", "", 3, True)]
    got = values(spark, rows, "l double, r double, rt string, tail string, n int, want boolean", tx.pair_may_form(F.col("l"), F.col("r"), F.col("rt"), F.col("tail"), F.lit("horizontal"), F.col("n")), "want")
    assert all(a == b for a, b in got)
    assert values(spark, [("unresolved_vertical_fragment",)], "o string", tx.pair_may_form(F.lit(17.0), F.lit(28.0), F.lit("28"), F.lit(""), F.col("o"))) == [(False,)]
    same = values(spark, [(None, None), ("rotated", "horizontal"), ("vertical", None), ("odd", "odd"), ("vertical", "horizontal")], "a string, b string", tx.same_reading(F.col("a"), F.col("b")))
    assert [x for (x,) in same] == [True, True, False, True, False]
    chars = F.transform(F.split("t", ""), lambda c: F.struct(c.alias("char")))
    assert values(spark, [("5±0.2",)], "t string", chains.chain_text(chars, F.lit("vertical")), chains.chain_text(chars, F.lit("horizontal"))) == [("5 ±0.2", "5±0.2")]
    at = spark.createDataFrame([(1, 2.0, 5.0), (2, 2.0, 3.0), (3, 1.0, 9.0)], "n int, x double, y double")
    order = lambda axis: [r["n"] for r in at.orderBy(chains.reading_order(F.lit(axis), F.col("x"), F.col("y")), "n").collect()]
    assert (order("horizontal"), order("vertical"), order("angled")) == ([3, 1, 2], [3, 1, 2], [3, 2, 1])
    assert [r[0] for r in spark.range(1).select(geometry.page_height(F.array(*map(F.lit, (0.0, 5.0, 9.0, 45.0))))).collect()] == [40.0]
    lone = spark.createDataFrame(word("d", "7"), GLYPH)
    assert [(r["dimension_axis"], r["h_near"], r["v_near"]) for r in chains.with_axes(chains.neighbor_counts(chains.with_thresholds(chains.with_metrics(lone)))).collect()] == [("vertical", 0, 0)]
    assert values(spark, [("١٢",), ("12",)], "t string", tx.is_number_token(F.col("t"))) == [(False,), (True,)]


ENTITY = "doc_id string, page int, seq long, x0 double, y0 double, x1 double, y1 double, cx double, cy double, nominal double, nominal_text string, display_text string, tolerance double, tolerance_text string, orientation string, dimension_axis string, glyph_count int"


def entity(seq, x, y, nominal, text=None, tolerance=None, axis="horizontal", w=10.0):
    text = text or f"{nominal:g}"
    return ("d", 1, seq, x, y, x + w, y + 9, x + w / 2, y + 4.5, nominal, text, text, tolerance, None, axis, axis, len(text))


def mark(seq, x, y, text, axis="horizontal"):
    return ("d", 1, seq, text, x, y, x + 10, y + 9, x + 5, y + 4.5, axis, axis, 3)


def test_modifiers_attach_in_order(spark):
    """A number grows by its mark, so that the next mark finds another one nearest, or nothing."""
    marks = "doc_id string, page int, seq long, text string, x0 double, y0 double, x1 double, y1 double, cx double, cy double, orientation string, dimension_axis string, glyph_count int"
    attached = lambda e, m: {r["seq"]: (r["display_text"], r["x1"], r["cx"], r["glyph_count"]) for r in matching.attach_modifiers(spark.createDataFrame(m, marks), spark.createDataFrame(e, ENTITY)).collect()}
    # 20 takes the first mark; its centre moves from 105 to 122.5, so the second one is nearer to 30's than it was, and goes there.
    e = [entity(1, 100.0, 100.0, 20.0), entity(2, 92.0, 104.0, 30.0)]
    assert attached(e, [mark(10, 135.0, 100.0, "±0.2"), mark(11, 104.0, 102.0, "±0.5")]) == {1: ("20 ±0.2", 145.0, 122.5, 5), 2: ("30 ±0.5", 114.0, 103.0, 5)}
    # In the other order the first mark takes 20, which then is still the nearest for the second: that one is lost.
    assert attached(e, [mark(10, 104.0, 102.0, "±0.5"), mark(11, 135.0, 100.0, "±0.2")])[1][0] == "20 ±0.5"
    # A number with a tolerance takes no other, and there is no second choice.
    taken = [entity(1, 100.0, 100.0, 20.0, tolerance=0.1), entity(2, 60.0, 100.0, 30.0)]
    assert {k: v[0] for k, v in attached(taken, [mark(10, 112.0, 100.0, "±0.2")]).items()} == {1: "20", 2: "30"}
    # Upright: the mark stands above its number; one below it isn't its own.
    up = [entity(1, 100.0, 100.0, 20.0, axis="vertical")]
    assert attached(up, [mark(10, 100.0, 130.0, "±0.2", "vertical")])[1][0] == "20" and attached(up, [mark(10, 100.0, 70.0, "±0.2", "vertical")])[1][0] == "20 ±0.2"
    assert attached(e, [mark(10, 112.0, 100.0, "±15"), mark(11, 112.0, 100.0, "none")]) == attached(e, [mark(10, 500.0, 500.0, "±1")])


def test_references_are_strict(spark):
    rows = [entity(1, 100.0, 100.0, 20.0), entity(2, 120.0, 100.0, None, "(REF)"), entity(3, 300.0, 100.0, 7.0), entity(4, 400.0, 100.0, None, "(REF)"), entity(5, 500.0, 100.0, 8.0, "R8")]
    kinds = spark.createDataFrame(rows, ENTITY).withColumns({"entity_type": F.lit("linear_dimension"), "grammar_rule": F.lit("CHAIN_STRING")})
    shown = lambda df: sorted(r["display_text"] for r in df.collect())
    assert shown(matching.merge_references(kinds)) == ["20(REF)", "R8"]
    assert shown(matching.merge_references(kinds, strict=False)) == ["(REF)", "20(REF)", "7", "R8"]
    assert shown(matching.merge_references(kinds.where("seq in (3, 4)"))) == ["(REF)", "7"]


def test_stacks_have_no_bound_at_first(spark):
    """The first gap of a stack may be of any size; it bounds those that follow."""
    def stack(doc, ys):
        return [(doc, 1, n, 100.0, y, 105.0, y + 9, 102.5, y + 4.5, None, None, str(n + 1), None, None, "unresolved_vertical_fragment", "vertical", 1) for n, y in enumerate(ys)]

    rows = spark.createDataFrame(stack("far", [500.0, 300.0, 290.0]) + stack("near", [500.0, 488.0, 400.0]), ENTITY)
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("entity_type", "string"), ("grammar_rule", "string"), ("reading_direction", "string"), ("axis_bucket", "int"))})
    assert sorted((r["doc_id"], r["display_text"]) for r in matching.fuse_stacked_digits(rows).collect()) == [("far", "123"), ("near", "12")]


def nearest(spark, cells, few, monkeypatch):
    monkeypatch.setattr(spatial, "FEW_DRAWINGS", few)
    e, d = cells
    return {(r["doc_id"], r["seq"]): (r["distance"], r["near_x0"], r["near_y0"]) for r in spatial.nearest_drawing(e, d).collect()}


def test_nearest_drawings_by_cells(spark, monkeypatch):
    """Cells of growing size find what trying all drawings finds: dense, sparse and far ones, ties and empty pages."""
    rng = random.Random(5)
    at = lambda wide: (rng.uniform(-wide, wide), rng.uniform(-wide, wide))
    points = [(f"p{wide}", 1, n, *at(wide)) for wide in (30, 900, 9000) for n in range(60)] + [("none", 1, 1, 0.0, 0.0), ("one", 1, 1, 1e6, -1e6), ("tie", 1, 1, 10.0, 10.0)]
    boxes = [(f"p{wide}", 1, n, x, y, x + n % 9, y + n % 5) for wide, held in ((30, 400), (900, 300), (9000, 5)) for n in range(held) for x, y in [at(wide)]]
    boxes += [("one", 1, 0, 0.0, 0.0, 1.0, 1.0), ("tie", 1, 4, 0.0, 10.0, 0.0, 10.0), ("tie", 1, 2, 20.0, 10.0, 20.0, 10.0)]
    cells = spark.createDataFrame(points, "doc_id string, page int, seq long, cx double, cy double"), spark.createDataFrame(boxes, BOX)
    all_of = nearest(spark, cells, 10**6, monkeypatch)
    assert nearest(spark, cells, 0, monkeypatch) == all_of and len(all_of) == len(points)
    assert all_of["none", 1] == (math.inf, None, None) and all_of["tie", 1] == (10.0, 20.0, 10.0)
    assert nearest(spark, cells, 20, monkeypatch) == all_of


def test_clip_meets_once(spark):
    rng = random.Random(6)
    box = lambda wide: (lambda x, y: (x, y, x + rng.uniform(-wide, wide), y + rng.uniform(-wide, wide)))(rng.uniform(-400, 400), rng.uniform(-400, 400))
    rows = [("d", n % 2, n, *box(20 if n % 9 else 700)) for n in range(900)]
    areas = [(n, "d", n % 2, *box(200), "center" if n % 3 else "any") for n in range(25)]
    got = spatial.clip(spark.createDataFrame(rows, BOX), spark.createDataFrame(areas, "region_id long, doc_id string, page int, x0 double, y0 double, x1 double, y1 double, glyph_mode string"))

    def meets(b, r, mode):
        x0, x1, y0, y1 = min(r[0], r[2]), max(r[0], r[2]), min(r[1], r[3]), max(r[1], r[3])
        if mode == "center":
            return x0 <= (b[0] + b[2]) / 2 <= x1 and y0 <= (b[1] + b[3]) / 2 <= y1
        return min(b[0], b[2]) < x1 and max(b[0], b[2]) > x0 and min(b[1], b[3]) < y1 and max(b[1], b[3]) > y0

    want = sorted((g[2], a[0]) for g in rows for a in areas if g[1] == a[2] and meets(g[3:7], a[3:7], a[7]))
    assert sorted((r["seq"], r["region_id"]) for r in got.collect()) == want and len(want) > 100


def test_order_of_nested_pages(spark):
    """Glyphs of several blocks and of a very long span keep their order, and formed pairs come after leftovers."""
    char = lambda c, x, y: {"c": c, "bbox": [float(x), float(y), x + 5.0, y + 9.0]}
    span = lambda chars: {"type": 0, "lines": [{"spans": [{"font": "F1", "size": 10.0, "chars": chars}]}]}
    blocks = [span([char("a", 0, 0)]), {"type": 1, "lines": []}, span([char("b", 0, 9)] + [char(" ", 0, 0)] * 33_000 + [char(c, n % 500, n) for n, c in enumerate("cd" * 17_000)]), span([char("e", 0, 0)])]
    flat = sheets.flatten_pages(spark.createDataFrame([("d", 1, blocks)], f"doc_id string, page int, {sheets.PAGE_JSON}"))
    got = flat.orderBy("seq").select("seq", "char").collect()
    assert [r["seq"] for r in got] == list(range(1, 34_004)) and got[0]["char"] + got[1]["char"] + got[-1]["char"] == "abe"
    text = lambda t, x: [char(c, x + 6 * n, 200) for n, c in enumerate(t)]
    pair = [span(text("17", 100)), span(text("28", 131)), span(text("9", 400)), span(text("45±90", 500))]
    page = sheets.flatten_pages(spark.createDataFrame([("d", 1, pair)], f"doc_id string, page int, {sheets.PAGE_JSON}"))
    found = matching.form_pairs(entities.with_pair_columns(entities.candidates(extract.page_chains(page)))).orderBy("seq").collect()
    assert [r["text"] for r in found] == ["90", "9", "4", "5", "17 X 28"] and found[1]["seq"] < registry.AFTER < found[2]["seq"] < found[3]["seq"] < registry.FORMED < found[-1]["seq"]


def test_regions_and_points(spark, pages):
    areas = spark.createDataFrame([(1, "M1", 1, 250.0, 300.0, 50.0, 100.0, "intersects"), (2, "M1", 1, 0.0, 0.0, 9.0, 9.0, "center"), (3, "M15", 1, 0.0, 700.0, 850.0, 800.0, "center")], "region_id long, doc_id string, page int, x0 double, y0 double, x1 double, y1 double, glyph_mode string")
    found = extract.extract_regions(*pages, areas)
    assert sorted((r["region_id"], r["display_text"]) for r in found.collect()) == [(1, "50.7 ±0.2"), (3, "123")]
    counted = extract.region_summary(areas, pages[2], found).collect()
    assert {r["region_id"]: r["entity_count"] for r in counted} == {1: 1, 2: 0, 3: 1}
    at = spark.createDataFrame([(7, "M7", 1, 105.0, 215.0, 40.0, "intersects"), (8, "M7", 1, 500.0, 500.0, 24.0, "intersects")], "point_id long, doc_id string, page int, x double, y double, radius double, glyph_mode string")
    got = {r["point_id"]: r for r in extract.snap(*pages, at).collect()}
    assert got[7]["selected"]["display_text"] == "R10" and got[7]["snap_distance"] == 6.0 and got[8]["selected"] is None and got[8]["candidate_count"] == 0


def test_sources_and_sinks(spark, pages, tmp_path):
    found = extract.extract_document(*pages)
    first, second = (sheets.write_versioned(found, f"{tmp_path}/out") for _ in range(2))
    assert (first[-3:], second[-3:]) == ("v=1", "v=2") and spark.read.json(second).count() == found.count()
    (tmp_path / "in").mkdir()
    for name, size in (("a.pdf", 64), ("b.pdf", 63), ("c.txt", 99)):
        (tmp_path / "in" / name).write_bytes(b"x" * size)
    taken, refused = sheets.read_uploads(spark, f"{tmp_path}/in")
    assert [r["doc_id"] for r in taken.collect()] == ["a"] and {r["reason"] for r in refused.collect()} == {"too small", "not a pdf"}
    with pytest.raises(ValueError):
        sheets.page_info(pages[2], "M1", 2)


def test_stream_equals_batch(spark, tmp_path):
    line = '{"doc_id":"d","page":1,"width":850,"height":800,"drawings":[[100,212,146,212]],"blocks":[{"type":0,"lines":[{"spans":[{"font":"F1","size":10,"chars":[%s]}]}]}]}'
    chars = ",".join(f'{{"c":"{c}","bbox":[{100 + 6 * i},200,{105 + 6 * i},209]}}' for i, c in enumerate("50.7±0.2"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.json").write_text(line % chars)
    ingest.stream_pages(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert [r["display_text"] for r in spark.read.parquet(f"{tmp_path}/out/records").collect()] == ["50.7 ±0.2"]


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(oracles.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    rows = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in got.collect()) == rows


def test_rows_only_queries(spark):
    for name in set(queries.QUERIES) - set(oracles.SQL):
        assert queries.QUERIES[name](spark, DATA).count() > 0, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(oracles.SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
