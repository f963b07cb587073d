"""What the page plans do where pages are dense, large or odd: each against brute force or against the same page whole."""

import json
import math
import random
import statistics
import threading
import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_drawings import BOX, ENTITY, GLYPH, entity, pages, word  # noqa: F401

from linework.operators import chains, entities, grammar, linking, matching, registry, spatial
from linework.plans import extract, queries
from linework.sources import scratch, sheets
from linework.streaming import ingest

REGION = "region_id long, doc_id string, page int, x0 double, y0 double, x1 double, y1 double, glyph_mode string"
POINT = "point_id long, doc_id string, page int, x double, y double, radius double, glyph_mode string"


@pytest.fixture
def small(monkeypatch):
    """Everything that is dealt out beyond some size is dealt out at once."""
    monkeypatch.setattr(linking, "FOLDED", 1)
    monkeypatch.setattr(linking, "PAGE_LINKS", 0)
    monkeypatch.setattr(chains, "TILE_GLYPHS", 20)


def test_ids_count_within_their_page(spark, pages):  # noqa: F811
    """Two documents with a point 7 and a region 1 each answer for themselves; the same row twice is one."""
    at = [(7, "M1", 1, 120.0, 205.0, 60.0, "intersects"), (7, "M12", 1, 120.0, 205.0, 60.0, "intersects"), (7, "M7", 1, 105.0, 215.0, 40.0, "intersects")]
    got = {r["doc_id"]: r for r in extract.snap(*pages, spark.createDataFrame(at + at[:1], POINT)).collect()}
    assert {d: (r["candidate_count"], r["selected"] and r["selected"]["display_text"]) for d, r in got.items()} == {"M1": (1, "50.7 ±0.2"), "M12": (0, None), "M7": (1, "R10")}
    areas = [(1, d, 1, 50.0, 100.0, 250.0, 300.0, "intersects") for d in ("M1", "M12", "M7")]
    areas = spark.createDataFrame([*areas, areas[0], (2, "M1", 1, 40.0, 100.0, 260.0, 300.0, "intersects"), (3, "M1", 1, 40.0, 100.0, 125.0, 300.0, "intersects")], REGION)
    found = extract.extract_regions(*pages, areas)
    counted = {(r["doc_id"], r["region_id"]): (r["entity_count"], [e["display_text"] for e in r["entities"] or ()]) for r in extract.region_summary(areas, pages[2], found).collect()}
    assert counted == {("M1", 1): (1, ["50.7 ±0.2"]), ("M12", 1): (0, []), ("M7", 1): (1, ["R10"]), ("M1", 2): (1, ["50.7 ±0.2"]), ("M1", 3): (1, ["50.7"])}
    clips = extract.clip_classes(spatial.clip(pages[0], areas.distinct()), spatial.clip(pages[1], areas.distinct(), by_mode=False))
    assert {(r["doc_id"], r["region_id"]): r["first_id"] for r in clips.collect()} == {("M1", 1): 1, ("M1", 2): 1, ("M1", 3): 3, ("M12", 1): 1, ("M7", 1): 1}


def test_clip_of_boxes_of_any_size(spark):
    rng = random.Random(8)
    nan, inf = math.nan, math.inf
    odd = [(0.0, 0.0, 1e6, 1e6), (-1e6, 5.0, 1e6, 6.0), (nan, 0.0, 9.0, 9.0), (None, 0.0, 9.0, 9.0), (-inf, -inf, inf, inf), (1e300, 0.0, 1e301, 9.0), (5e11, 5e11, 5e11 + 300, 5e11 + 300)]
    span = lambda wide: [(x, y, x + rng.uniform(0, wide), y + rng.uniform(0, wide)) for x, y in [(rng.uniform(-3e3, 3e3), rng.uniform(-3e3, 3e3))]][0]
    boxes = odd + [span(rng.choice((5, 300, 4e3, 1e5))) for _ in range(300)]
    areas = odd + [span(rng.choice((5, 100, 700, 2e3, 9e3, 4e4, 2e5, 1e6))) for _ in range(60)]
    rows = spark.createDataFrame([("d", 1, n, *b) for n, b in enumerate(boxes)] + [("other", 1, 0, 0.0, 0.0, 1e9, 1e9)], BOX)
    regions = spark.createDataFrame([(n, "d", 1, *a, "any") for n, a in enumerate(areas)], REGION)
    ok = lambda b: all(c is not None and c == c for c in b)
    want = sorted((i, j) for i, b in enumerate(boxes) for j, a in enumerate(areas) if ok(a) and ok(b) and b[0] < a[2] and b[2] > a[0] and b[1] < a[3] and b[3] > a[1])
    got = spatial.clip(rows, regions)
    assert sorted((r["seq"], r["region_id"]) for r in got.collect()) == want and len(want) > 1000
    stood = spatial._region_levels(regions.select("doc_id", "page", "region_id", *(F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1"))).where(spatial._sound(spatial.Box.of("r_"))))
    assert stood.select("level").distinct().count() <= spatial.REGION_LEVELS


def test_few_regions_are_all_tried(spark, monkeypatch, capsys):
    """Pages of few regions make no rows of the grid, and no table that grows with the pages is sent to all tasks; both ways meet the same."""
    rng = random.Random(12)
    box = lambda wide: (lambda x, y: (x, y, x + rng.uniform(-wide, wide), y + rng.uniform(-wide, wide)))(rng.uniform(-300, 300), rng.uniform(-300, 300))
    rows = spark.createDataFrame([("d", n % 3, n, *box(30 if n % 9 else 900)) for n in range(600)] + [("d", 1, 900, None, 0.0, 1.0, 1.0), ("d", 1, 901, math.nan, 0.0, 1.0, 1.0)], BOX)
    areas = [(n, "d", int(n > 5), *box(200), "center" if n % 3 else "any") for n in range(26)] + [(40, "d", 1, -math.inf, -math.inf, math.inf, math.inf, "any"), (41, "d", 1, None, 0.0, 9.0, 9.0, "any")]
    regions, met = spark.createDataFrame(areas, REGION), []
    for few in (32, 10, 0):
        monkeypatch.setattr(spatial, "FEW_REGIONS", few)
        met.append([sorted(tuple(r) for r in spatial.clip(rows, regions, mode).select("seq", "region_id").collect()) for mode in (True, False)])
    assert met[0] == met[1] == met[2] and min(map(len, met[0])) > 300 and met[0][0] != met[0][1]
    monkeypatch.undo()
    capsys.readouterr()
    spatial.clip(rows, regions).explain()
    plan = capsys.readouterr().out
    assert "ShuffledHashJoin" in plan and "gx" not in plan and "Broadcast" not in plan


def test_long_methods_are_compiled(spark, data, monkeypatch):
    """A session's own limit stays, Spark's is lowered to what the JVM compiles."""
    n = "spark.sql.codegen.hugeMethodLimit"
    held = spark.conf.get(n)
    try:
        for before, after in (("65535", "8000"), ("20000", "20000")):
            spark.conf.set(n, before)
            queries.annotations(spark, data)
            assert spark.conf.get(n) == after
    finally:
        spark.conf.set(n, held)


def _random_glyphs(rng, docs, most, sizes=(10.0,)):
    out = []
    for d in range(docs):
        for n in range(rng.randrange(1, most)):
            x, y = rng.choice((rng.uniform(0, 120), 6.0 * rng.randrange(20))), rng.choice((rng.uniform(0, 90), 9.0 * rng.randrange(9)))
            out.append((f"d{d}", 1, n, rng.choice("0123456789±X.R"), x, y, x + rng.choice((4.0, 5.0)), y + rng.choice((8.0, 9.0)), rng.choice(("F1", "F2")), rng.choice(sizes)))
    return out


@pytest.mark.parametrize("sizes", [(10.0,), (10.0, 10.01, 14.0, 14.02), tuple(8 + k / 7 for k in range(40))])
def test_neighbours_are_brute_force(spark, small, sizes):
    rows = _random_glyphs(random.Random(3), 6, 160, sizes)
    g = chains.with_thresholds(chains.with_metrics(spark.createDataFrame(rows, GLYPH)))
    assert "tile" in g.columns
    got = {(r["doc_id"], r["seq"]): (r["h_near"], r["v_near"]) for r in chains.neighbor_counts(g).collect()}
    for doc in {r[0] for r in rows}:
        page = [((r[4] + r[6]) / 2, (r[5] + r[7]) / 2, r[8], r[9], r[2]) for r in rows if r[0] == doc]
        w, h = statistics.median(r[6] - r[4] for r in rows if r[0] == doc), statistics.median(r[7] - r[5] for r in rows if r[0] == doc)
        line, col, hg, vg, st = max(h * 0.5, 2), max(w * 0.35, 2), max(w * 1.8, 6), max(h * 1.8, 6), max(h * 0.35, 0.5)
        for cx, cy, font, size, seq in page:
            alike = [(abs(x - cx), abs(y - cy)) for x, y, f, s, _ in page if f == font and abs(s - size) <= st]
            assert got[doc, seq] == (sum(0 < dx <= hg and dy <= line for dx, dy in alike), sum(0 < dy <= vg and dx <= col for dx, dy in alike))
    assert len(got) == len(rows)


@pytest.mark.parametrize(("few", "odd"), [(400, ()), (3, ()), (400, (math.nan, math.inf)), (400, (1e300,))])
def test_many_pages_are_counted_at_once(monkeypatch, few, odd):
    """Groups side by side in one call, tried pair by pair or swept, are brute force."""
    monkeypatch.setattr(chains, "FEW_ABOUT", few)
    monkeypatch.setattr(chains, "BLOCK", 50)
    rng = np.random.default_rng(4)
    n = 400
    group, x, y, size = rng.integers(0, 9, n), rng.integers(0, 30, n) * 3.3 - 40, rng.integers(0, 30, n) * 1.1, rng.choice((9.0, 10.0, 14.0), n)
    x[: len(odd)] = odd
    own, (reach, tol, fit) = rng.random(n) < 0.8, (rng.random((9)) * k for k in (20, 9, 5))
    with np.errstate(all="ignore"):
        apart = np.abs(x[:, None] - x)
        met = (group[:, None] == group) & (apart > 0) & (apart <= reach[group][:, None]) & (np.abs(y[:, None] - y) <= tol[group][:, None]) & (np.abs(size[:, None] - size) <= fit[group][:, None])
    got = chains._about(group, x, y, size, own, reach[group], tol[group], fit[group])
    assert (got == met.sum(axis=1) * own).all() and got.sum() > 200


def test_lines_of_many_pages_are_linked_at_once():
    rng = random.Random(9)
    rows = pd.DataFrame([(f"d{k % 7}", 1, k, "horizontal", rng.randrange(2), rng.choice(("F1", None)), rng.uniform(0, 60), rng.choice((9.0, 10.0, 14.0)), 6.0, 2.0) for k in range(300)], columns=["doc_id", "page", "seq", "dimension_axis", "axis_bucket", "font", "along", "size", "reach", "size_tol"])
    want = {s: c for _, page in rows.groupby("doc_id") for s, c in chains._linked(page, ["doc_id", "page"])[["seq", "component"]].itertuples(index=False)}
    got = dict(chains._linked(rows, ["doc_id", "page"])[["seq", "component"]].itertuples(index=False))
    assert got == want and 7 < len(set(want.values())) < 300


def _chain_rows(df):
    return sorted((r["doc_id"], r["seq"], r["text"], r["orientation"] or "", r["glyph_count"], r["x0"], r["y0"]) for r in df.collect())


def test_pages_in_parts_equal_whole_pages(spark, monkeypatch):
    rng = random.Random(11)
    rows = [g for d in range(8) for k in range(25) for g in word(f"d{d}", rng.choice(("12X28", "50.7±0.2", "28", "R10", "7", "12±5")), x=rng.choice((40.0, 200.0, rng.uniform(0, 700))), y=rng.choice((100.0, 112.0, rng.uniform(0, 700))), font=rng.choice(("F1", "F2")), seq=k * 20)]
    rows += [(f"m{d}", *g[1:]) for d in range(3) for g in _random_glyphs(rng, 1, 150, (9.0, 10.0, 14.0))]
    glyphs = spark.createDataFrame(rows, GLYPH)
    whole = _chain_rows(extract.page_chains(glyphs))
    pairs = sorted(map(str, matching.form_pairs(entities.with_pair_columns(entities.candidates(extract.page_chains(glyphs)))).select("doc_id", "seq", "text").collect()))
    for module, name, value in ((linking, "FOLDED", 1), (linking, "PAGE_LINKS", 0), (chains, "TILE_GLYPHS", 20)):
        monkeypatch.setattr(module, name, value)
    assert _chain_rows(extract.page_chains(glyphs)) == whole and len(whole) > 300
    assert sorted(map(str, matching.form_pairs(entities.with_pair_columns(entities.candidates(extract.page_chains(glyphs)))).select("doc_id", "seq", "text").collect())) == pairs


def plain_order(groups):
    """All groups of a page in order, as the rule has it: kept dimensions and the glyphs left over."""
    place = lambda g, digits: (g["cx"], g["cy"], g["char"]) if digits is None else (round(g["cx"], digits), round(g["cy"], digits), g["char"])
    used, taken, pairs, kept = set(), set(), set(), []
    order = sorted(groups, key=lambda r: (r["axis_rank"], r["bucket_first"], r["component"], r["chunk"], r["piece"]))
    for r in order:
        if any(place(g, None) in used or place(g, 1) in taken for g in r["glyphs"]):
            continue
        if r["has_operator"] and not r["found"]:
            used |= {place(g, None) for g in r["glyphs"]}
        for d in r["found"]:
            own = [g for g in r["glyphs"] if g["seq"] in d["ids"]]
            if any(place(g, None) in used or place(g, 1) in taken for g in own):
                continue
            key = (r["dimension_axis"], *sorted(d["values"])) if d["entity_type"] == "SRC_dimension" else None
            if key and key in pairs:
                taken |= {place(g, 1) for g in own}
                continue
            pairs.add(key)
            used |= {place(g, None) for g in own}
            taken |= {place(g, 1) for g in own}
            kept.append(d["text"])
    return kept


def test_order_is_the_rule(spark, small):
    rng = random.Random(5)
    rows = []
    for d in range(12):
        for k in range(14):
            x, y = 40.0 + 90 * rng.randrange(4), 100.0 + 40 * rng.randrange(4)
            rows += word(f"d{d}", rng.choice(("12X28", "28X12", "50.7±0.2", "9±", "17X28", "33")), x=x, y=y, font=rng.choice(("F1", "F2", "F3")), seq=k * 20)
    g = chains.with_axes(chains.neighbor_counts(chains.with_thresholds(chains.with_metrics(spark.createDataFrame(rows, GLYPH)))))
    groups = scratch.save(registry.ordered(grammar.groups(chains.split_components(chains.components(g)))), "groups")
    found = {}
    for r in registry.chains(groups).orderBy("seq").collect():
        if r["chain_id"] is not None:
            found.setdefault(r["doc_id"], []).append(r["text"])
    pages_of = {}
    for r in groups.collect():
        pages_of.setdefault(r["doc_id"], []).append(r)
    assert found == {d: k for d, k in ((d, plain_order(p)) for d, p in pages_of.items()) if k} and sum(map(len, found.values())) > 60


def _edges(rng, n):
    return [(f"d{d}", 1, l, r, float(rng.randrange(6))) for d in range(4) for l, r in sorted({(rng.randrange(n), 1000 + rng.randrange(n)) for _ in range(3 * n)})]


def plain_greedy(rows):
    lefts, rights, out = set(), set(), []
    for doc, _, l, r, d in sorted(rows, key=lambda x: (x[0], x[2], x[4], x[3])):
        if (doc, l) not in lefts and (doc, r) not in rights:
            lefts.add((doc, l))
            rights.add((doc, r))
            out.append((doc, l, r))
    return sorted(out)


def test_greedy_matches(spark, monkeypatch):
    rows = [*_edges(random.Random(1), 9), *_edges(random.Random(2), 40), ("lone", 1, 1, 2, 0.5)]
    frame = spark.createDataFrame(rows, "doc_id string, page int, l long, r long, d double")
    got = lambda: sorted((x["doc_id"], x["tseq"], x["nseq"]) for x in matching._greedy(frame.toDF("doc_id", "page", "tseq", "nseq", "gap"), ["doc_id", "page"], "tseq", "nseq", "gap").collect())
    assert got() == plain_greedy(rows)
    monkeypatch.setattr(linking, "FOLDED", 3)
    monkeypatch.setattr(linking, "PAGE_LINKS", 40)
    assert got() == plain_greedy(rows)


def plain_pairs(numbers):
    """Neighbours on a line, from its start on: what forms, each number and each pair once."""
    lines = {}
    for n in numbers:
        lines.setdefault(n["axis_bucket"], []).append(n)
    used, pairs, out = set(), set(), []
    for _, line in sorted((min(n["seq"] for n in line), sorted(line, key=lambda n: (n["cx"], n["seq"]))) for line in lines.values()):
        for a, b in zip(line, line[1:], strict=False):
            gap = b["x0"] - a["x1"]
            mark = lambda n: (round(n["cx"], 1), round(n["cy"], 1), n["text"])
            pair = tuple(sorted((float(a["text"]), float(b["text"]))))
            room = max(a["x1"] - a["x0"], b["x1"] - b["x0"], 1.0) * 0.35
            if 0 < gap <= 6 * 300 / 25.4 and gap >= room and max(pair) >= 10 and mark(a) not in used and mark(b) not in used and pair not in pairs:
                used |= {mark(a), mark(b)}
                pairs.add(pair)
                out.append(f"{a['text']} X {b['text']}")
    return out


def _numbers(rng, doc, n, lines):
    out = []
    for k in range(n):
        line = rng.randrange(lines)
        x, text = rng.choice((25.0 * rng.randrange(n), rng.uniform(0, 25.0 * n))), str(rng.randrange(10, 10 + n // 3))
        out.append((doc, 1, k, text, x, 20.0 * line, x + 11, 20.0 * line + 9, x + 5.5, 20.0 * line + 4.5, 2, "horizontal", "horizontal", line, None, None))
    return out


NUMBER = "doc_id string, page int, seq long, text string, x0 double, y0 double, x1 double, y1 double, cx double, cy double, glyph_count int, orientation string, dimension_axis string, axis_bucket int, entity_type string, values array<double>"


def test_pairs_form_by_the_rule(spark, monkeypatch):
    rng = random.Random(7)
    rows = [r for d, n in enumerate((4, 30, 60, 60)) for r in _numbers(rng, f"d{d}", n, 1 + d)]
    frame = entities.with_pair_columns(spark.createDataFrame(rows, NUMBER)).withColumn("grammar_fused", F.lit(False))
    for c, t in (("grammar_rule", "string"), ("operator", "string"), ("reading_direction", "string"), ("direction_locked", "boolean")):
        frame = frame.withColumn(c, F.lit(None).cast(t))

    def formed():
        out = {}
        for r in matching.form_pairs(frame).where("entity_type is not null").orderBy("doc_id", "seq").collect():
            out.setdefault(r["doc_id"], []).append(r["text"])
        return out

    names = NUMBER.replace(",", "").split()[::2]
    want = {d: found for d in {r[0] for r in rows} if (found := plain_pairs([dict(zip(names, r, strict=True)) for r in rows if r[0] == d]))}
    assert formed() == want and sum(map(len, want.values())) > 20
    monkeypatch.setattr(linking, "FOLDED", 3)
    monkeypatch.setattr(linking, "PAGE_LINKS", 5)
    assert formed() == want


def test_dense_pages_take_linear_time(spark):
    """A page of 8,000 one-glyph groups, of 10,000 marks and of 10,000 bare numbers: seconds, not minutes."""
    g = spark.range(8000).selectExpr("'d' doc_id", "1 page", "id seq", "'7' char", "cast(id % 90 * 40 as double) x0", "cast(floor(id / 90) * 40 as double) y0").selectExpr("*", "x0 + 5 x1", "y0 + 9 y1", "'F1' font", "10.0D size")
    extract.page_chains(g.limit(5)).collect()
    began = time.time()
    assert extract.page_chains(g).count() == 8000
    assert time.time() - began < 40
    e = spark.range(20_000).selectExpr("'d' doc_id", "1 page", "id seq", "cast(id as double) as l")
    p = e.where("seq % 2 = 0").selectExpr("doc_id", "page", "seq tseq", "explode(array(seq + 1, seq + 3)) nseq", "cast(seq % 7 as double) gap")
    began = time.time()
    assert matching._greedy(p, ["doc_id", "page"], "tseq", "nseq", "gap").count() == 10_000
    assert time.time() - began < 25


def _explained(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_small_files_are_not_broadcast(spark, capsys):
    """Points that look into nine cells each are many more than their file's size says."""
    p = scratch.save(spark.range(2000).selectExpr("'d' doc_id", "id page", "id seq", "cast(id % 7 as double) x", "1.0D y"), "points")
    met = spatial.within(p.withColumnRenamed("seq", "l"), p.toDF("doc_id", "page", "r", "cx", "cy"), ["doc_id", "page"], 3.0, ("x", "y"), ("cx", "cy"))
    assert "BroadcastHashJoin" not in _explained(met, capsys) and met.count() == 2000
    assert "BroadcastHashJoin" not in _explained(p.join(matching._greedy(met, ["doc_id", "page"], "l", "r", "gap"), ["doc_id", "page"]), capsys)


def _counted_glyphs(spark, data):
    return chains.with_axes(chains.neighbor_counts(chains.with_thresholds(chains.with_metrics(queries.glyphs(queries.annotations(spark, data))))))


def test_even_pages_are_counted_once(spark, data, capsys):
    """Where no page's sizes differ, components read the glyphs once; the pairwise way finds the same."""
    g = _counted_glyphs(spark, data)
    found = chains.components(g)
    assert _explained(found, capsys).count("FlatMapGroupsIn") == 1
    rows = lambda df: sorted(map(tuple, df.select("seq", "component").collect()))
    assert rows(found) == rows(chains.components(g.withColumn("uneven", F.lit(True))))
    for odd in (14.0, None):
        sized = queries.glyphs(queries.annotations(spark, data)).withColumn("size", F.when(F.col("seq") != 33, F.col("size")).otherwise(F.lit(odd)))
        assert not chains.all_even(chains.with_thresholds(chains.with_metrics(sized)))


def test_lines_are_dealt_once(spark, data, monkeypatch, capsys):
    """From counted glyphs to groups in order: one exchange by line where sizes are even."""
    plans = {}
    monkeypatch.setattr(extract, "save", lambda df, name: plans.setdefault(name, _explained(df, capsys)) and scratch.save(df, name))
    extract.page_chains(queries.glyphs(queries.annotations(spark, data)))
    assert sum("Exchange" in line and "axis_bucket" in line for line in plans["groups"].splitlines()) == 1


def test_groups_that_share_nothing_are_not_sorted(spark, data, monkeypatch, capsys):
    """Few groups that share a place go to all tasks; many meet by a merge, with the same chains."""
    groups = scratch.save(registry.ordered(grammar.groups(chains.split_components(chains.components(_counted_glyphs(spark, data))))), "groups")
    few = registry.chains(groups)
    assert "SortMergeJoin" not in _explained(few, capsys)
    monkeypatch.setattr(scratch, "FEW_ROWS", -1)
    many = registry.chains(groups)
    assert "SortMergeJoin" in _explained(many, capsys)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(few) == rows(many)


def test_chains_of_one_number_need_no_tokens(spark, monkeypatch):
    """Read through their tokens they give the same, whatever their gaps and characters."""
    rng = random.Random(5)
    chars = [*"0123456789..RXT(() \u00b0", "12", "", None]
    made = [(n, [(sum(gaps[: k + 1]), k, c) for k, c in enumerate(rng.choices(chars, k=len(gaps)))]) for n in range(1500) for gaps in [[rng.choice((0.0, 6.0, 6.0, 6.0, 10.0, 11.0, 40.0)) for _ in range(rng.randrange(7))]]]
    made += [(1500, [(0.0, 0, "1"), (None, 1, "2"), (math.nan, 2, "3")])]
    df = spark.createDataFrame(made, "n long, g array<struct<along:double,seq:long,char:string>>")
    find = lambda: sorted(map(str, df.select("n", grammar.dimensions(F.col("g"), F.lit(False)).alias("found")).collect()))
    assert df.where(grammar._one_number(F.col("g"))).count() > 300
    fast = find()
    monkeypatch.setattr(grammar, "_one_number", lambda g: F.lit(False))
    monkeypatch.setattr(grammar, "_spaced", lambda g: F.lit(True))
    assert fast == find()


def test_pairs_are_judged_once(spark, monkeypatch, capsys):
    """Neighbours on a line meet no table of lines, and numbers are written out once, not in a filter."""
    plans = {}
    monkeypatch.setattr(matching, "save", lambda df, name: plans.setdefault(name, _explained(df, capsys)) and scratch.save(df, name))
    spots = [(1, 0.0, 0.0, "12"), (2, 40.0, 0.0, "13"), (3, 0.0, 50.0, "5"), (4, 400.0, 50.0, "6"), (5, 0.0, 90.0, "7"), (6, 0.0, 130.0, "14"), (7, 40.0, 130.0, "15")]
    a = spark.createDataFrame([(n, "d", 1, x, y, t) for n, x, y, t in spots], "event_id long, doc_id string, page int, ax double, ay double, text string")
    found = matching.form_pairs(entities.with_pair_columns(queries.candidate_rows(a))).where("entity_type = 'SRC_dimension'")
    assert sorted((r["text"], r["semantic_zone_id"]) for r in found.collect()) == [("12 X 13", 1), ("14 X 15", 3)]
    assert "Join" not in plans["neighbours"] and not any("Filter" in line and "format_string" in line for line in plans["neighbours"].splitlines())


def test_nearest_drawings_sort_no_pairs(spark, capsys):
    """A page's drawings meet its entities as one row; dense pages and pages with none beside it."""
    rng = random.Random(2)
    spots = [(f"d{d}", 1, n, x, y, x + 4, y + 2) for d, many in ((0, 5), (1, 300)) for n in range(many) for x, y in [(rng.randrange(90) * 5.0, rng.randrange(90) * 5.0)]]
    drawn = spark.createDataFrame(spots, BOX)
    points = [(f"d{d}", 1, n, rng.uniform(0, 450), rng.uniform(0, 450)) for d in range(3) for n in range(40)]
    near = spatial.nearest_drawing(spark.createDataFrame(points, "doc_id string, page int, seq long, cx double, cy double"), drawn.where("doc_id <> 'd1'"))
    assert "SortAggregate" not in _explained(near, capsys)
    near = spatial.nearest_drawing(spark.createDataFrame(points, "doc_id string, page int, seq long, cx double, cy double"), drawn)
    got = {(r["doc_id"], r["seq"]): (r["distance"], r["near_x0"], r["near_y0"]) for r in near.collect()}
    for doc, _, seq, x, y in points:
        best = min(((math.dist((x, y), (s[3] + 2, s[4] + 1)), s[2], s) for s in spots if s[0] == doc), default=None)
        assert got[doc, seq] == ((pytest.approx(best[0]), best[2][3], best[2][4]) if best else (math.inf, None, None))


def test_pages_fold_together_as_alone():
    """Many pages in one call of a fold: each as by itself."""
    rng = random.Random(3)
    edges = pd.DataFrame([(p, rng.randrange(6), rng.randrange(6), float(rng.randrange(4))) for p in range(9) for _ in range(8)], columns=["page_no", "l", "r", "d"]).drop_duplicates(["page_no", "l", "r"])
    couples = pd.DataFrame([(p, k // 3, k % 3, f"n{rng.randrange(5)}", f"n{rng.randrange(5, 9)}", f"p{rng.randrange(4)}") for p in range(9) for k in range(9)], columns=["page_no", "line_first", "nth", "ka", "kb", "pair"])
    at = lambda n: {"x0": 9.0 * n, "y0": 0.0, "x1": 9.0 * n + 5, "y1": 9.0, "cx": 9.0 * n + 2.5, "cy": 4.5, "dimension_axis": "horizontal", "family": ""}
    marks = pd.DataFrame([{"page_no": p, "seq": n + 100 * mark, **at(rng.uniform(0, 6)), "value": 0.5 if mark else None, "nominal": None if mark else 50.0, "free": True} for p in range(9) for n in range(6) for mark in (0, 1)])
    for fold, rows in ((matching._take_nearest, edges), (matching._take_pairs, couples), (matching._attached, marks)):
        rows = rows.sample(frac=1, random_state=1)
        alone = [fold(page) for _, page in rows.groupby("page_no")]
        assert sorted(fold(rows).itertuples(index=False, name=None)) == sorted(x for a in alone for x in a.itertuples(index=False, name=None)) and all(map(len, alone))


def test_modifiers_go_in_turns(monkeypatch):
    """The nth modifiers of all pages go in one step; each as the rule has it, one by one."""
    rng = random.Random(21)
    spot = lambda: (lambda x, y: {"x0": x, "y0": y, "x1": x + 5, "y1": y + 9, "cx": x + 2.5, "cy": y + 4.5})(rng.randrange(15) * 4.0, rng.randrange(8) * 4.0)
    rows = [{"page_no": p, "seq": n + 100 * mark, **spot(), "dimension_axis": rng.choice(("horizontal", "vertical")), "family": rng.choice(("", "", "a")), "value": rng.choice((0.5, 3.0)) if mark else None, "nominal": None if mark else rng.choice((0.0, 4.0, 50.0)), "free": n % 5 > 0} for p in range(40) for mark in (0, 1) for n in range(rng.randrange(0, 12))]
    want = []
    for p in range(40):
        numbers = [dict(r) for r in rows if r["page_no"] == p and r["value"] is None]
        for m in (r for r in rows if r["page_no"] == p and r["value"] is not None):
            best = None
            for e in numbers:
                dx, dy = m["cx"] - e["cx"], e["cy"] - m["cy"]
                gap = math.sqrt(dx * dx + dy * dy)
                near = abs(dx) <= 12 and gap <= 90 and dy >= 0 if e["dimension_axis"] == "vertical" else abs(dy) <= 12 and gap <= 60 and dx >= 0
                if near and (e["dimension_axis"], e["family"]) == (m["dimension_axis"], m["family"]) and (e["nominal"] == 0 or m["value"] <= abs(e["nominal"]) / 2) and (best is None or gap < best[0]):
                    best = gap, e
            if best and best[1]["free"]:
                e = best[1]
                e.update(free=False, x0=min(e["x0"], m["x0"]), y0=min(e["y0"], m["y0"]), x1=max(e["x1"], m["x1"]), y1=max(e["y1"], m["y1"]))
                e.update(cx=(e["x0"] + e["x1"]) / 2, cy=(e["y0"] + e["y1"]) / 2)
                want.append((p, m["seq"], e["seq"]))
    steps, sqrt = [], np.sqrt
    monkeypatch.setattr(matching.np, "sqrt", lambda x: steps.append(1) or sqrt(x))
    found = matching._attached(pd.DataFrame(rows).sample(frac=1, random_state=1))
    assert sorted(found.itertuples(index=False, name=None)) == sorted(want) and len(want) > 30
    assert len(steps) <= 11
    none = pd.DataFrame(rows)
    assert matching._attached(none[none["value"].isna()]).empty and matching._attached(none[none["value"].notna()]).empty


def test_texts_of_entities_are_read_once(spark, capsys):
    rows = spark.createDataFrame([("d", 1, "20 X 30")], "doc_id string, page int, text string")
    null = {"cx": "double", "cy": "double", "entity_type": "string", "values": "array<double>", "grammar_fused": "boolean", "tolerance_value": "double", "nominal": "double", "nominal_text": "string", "grammar_rule": "string", "operator": "string", "chain_id": "int", "direction_locked": "boolean"}
    rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in null.items()})
    plan = _explained(entities.build(rows), capsys)
    assert plan.count("regexp_extract") <= 6 and "exists(" not in plan
    assert entities.build(rows).first()["values"] == [20.0, 30.0]


def test_partitions_follow_the_events(spark, data, monkeypatch):
    held = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        queries._events(spark, data)
        assert spark.conf.get("spark.sql.shuffle.partitions") == held["spark.sql.shuffle.partitions"]
        assert int(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) == queries.TASK_BYTES
        monkeypatch.setattr(queries, "EVENTS_A_PART", 999)
        assert queries._events(spark, data).count() == 10_000 and spark.conf.get("spark.sql.shuffle.partitions") == "11"
    finally:
        for n, v in held.items():
            spark.conf.set(n, v)


def test_components(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(d, rng.randrange(200), rng.randrange(200)) for d in range(3) for _ in range(120)] + [(9, k, k + 1) for k in range(60)]
    frame = spark.createDataFrame(rows, "page int, u long, v long")
    got = lambda: sorted(tuple(r) for r in linking.connected(frame, ["page"]).select("page", "node", "component").collect())
    want = got()
    least = {(p, n): c for p, n, c in want}
    assert all(least[p, u] == least[p, v] <= min(u, v) for p, u, v in rows) and {c for p, _, c in want if p == 9} == {0}
    monkeypatch.setattr(linking, "PAGE_LINKS", 100)
    assert got() == want
    assert linking.connected(frame.where("false"), ["page"]).count() == 0


def test_versions_are_claimed(spark, tmp_path):
    """Writers at once get versions of their own; one that fails leaves nothing to be seen."""
    rows = spark.createDataFrame([(1, 0.5, "a")], "seq long, distance double, text string")
    got = []
    threads = [threading.Thread(target=lambda: got.append(sheets.write_versioned(rows, f"{tmp_path}/out"))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(p[-3:] for p in got) == ["v=1", "v=2", "v=3", "v=4"] and all(spark.read.json(p).count() == 1 for p in got)
    broken = rows.withColumn("text", F.raise_error("killed"))
    with pytest.raises(Exception, match="killed"):
        sheets.write_versioned(broken, f"{tmp_path}/out")
    assert sheets.write_versioned(rows, f"{tmp_path}/out")[-3:] == "v=6" and not (tmp_path / "out" / "v=5").exists()
    assert spark.read.json(f"{tmp_path}/out").count() == 5 and not list((tmp_path / "out" / "_parts").iterdir())


def test_points_are_checked(spark):
    at = [(n, "d", 1, x, 1.0, r, "any") for n, (x, r) in enumerate([(0.0, 2.0), (0.0, 2.5), (0.0, 80.0), (0.0, 80.1), (0.0, None), (None, 9.0), (0.0, math.nan)])]
    taken, refused = sheets.check_points(spark.createDataFrame(at, POINT))
    assert {r["point_id"]: r["radius"] for r in taken.collect()} == {1: 2.5, 2: 80.0, 4: 24.0}
    assert {r["point_id"]: r["reason"] for r in refused.collect()} == {0: "radius out of range", 3: "radius out of range", 5: "no place", 6: "radius out of range"}


def test_scratch_of_two_threads(spark):
    """A table that one thread saves outlives another thread's temporary()."""
    inside, done, found = threading.Event(), threading.Event(), {}

    def other():
        inside.wait()
        found["table"] = scratch.save(spark.range(5), "kept")
        done.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch.temporary(spark):
        mine = scratch.save(spark.range(3), "mine")
        with scratch.temporary(spark):
            inner = scratch.save(spark.range(2), "inner")
        inside.set()
        done.wait()
        assert mine.count() == 3
        with pytest.raises(Exception):  # noqa: B017
            inner.count()
    thread.join()
    assert found["table"].count() == 5
    second = spark.newSession()
    theirs = scratch.save(second.range(4), "theirs")
    scratch.clear(spark)
    assert theirs.count() == 4
    scratch.clear(second)
    for gone in (mine, found["table"], theirs):
        with pytest.raises(Exception):  # noqa: B017
            gone.count()


def _page_file(path, doc, page, text, version=None):
    chars = [{"c": c, "bbox": [100 + 6 * i, 200, 105 + 6 * i, 209]} for i, c in enumerate(text)]
    held = {"doc_id": doc, "page": page, "width": 850, "height": 800, "drawings": [[100, 212, 146, 212]], "blocks": [{"type": 0, "lines": [{"spans": [{"font": "F1", "size": 10, "chars": chars}]}]}]}
    path.write_text(json.dumps(held | ({} if version is None else {"version": version})))


def test_pages_that_arrive_again(spark, tmp_path):
    """The newest version of a page stands once, a late one is dropped, and batches leave no tables behind."""
    source = tmp_path / "in"
    source.mkdir()
    shared = Path(scratch.shared_dir(spark).removeprefix("file://")) / "linework"
    held = lambda: len(list(shared.iterdir())) if shared.exists() else 0
    before = held()

    def run():
        ingest.stream_pages(spark, str(source), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        return sorted((r["doc_id"], r["page"], r["display_text"]) for r in spark.read.parquet(f"{tmp_path}/out/records").collect())

    _page_file(source / "a.json", "d", 1, "50.7±0.2", 2)
    _page_file(source / "b.json", "e", 1, "78.7(REF)", 1)
    assert run() == [("d", 1, "50.7 ±0.2"), ("e", 1, "78.7(REF)")]
    _page_file(source / "c.json", "d", 1, "R10", 1)
    _page_file(source / "c2.json", "d", 2, "R12", 1)
    assert run() == [("d", 1, "50.7 ±0.2"), ("d", 2, "R12"), ("e", 1, "78.7(REF)")]
    _page_file(source / "d.json", "d", 1, "R11", 3)
    _page_file(source / "d2.json", "d", 1, "R13", 4)
    _page_file(source / "d3.json", "e", 1, "12.25", 5)
    assert run() == [("d", 1, "R13"), ("d", 2, "R12")]
    _page_file(source / "e.json", "e", 1, "78.7(REF)", 4)
    assert run() == [("d", 1, "R13"), ("d", 2, "R12")] and held() == before
    assert {(r["doc_id"], r["page"]): r["version"] for r in spark.read.parquet(f"{tmp_path}/out/pages").collect()} == {("d", 1): 4, ("d", 2): 1, ("e", 1): 5}


def test_even_components_stay_whole(spark, monkeypatch):
    """Only components with a wide gap, of many glyphs or of unknown places are taken apart; the groups are those of all."""
    rng = random.Random(11)
    rows, at = [], 0.0
    for n in range(160):
        at, line = 0.0, n
        for _ in range(rng.choice((1, 2, 3, 5, 8, 14, 26))):
            rows.append((n // 40, 1, len(rows), rng.choice("0123456789.X") if n % 5 else rng.choice("12±7"), at, 20.0 * line))
            at += rng.choice((6.0, 6.0, 6.0, 2.0, 0.0, 16.0) if n % 3 else (6.0,))
    rows += [(4, 1, len(rows) + k, None, 6.0 * k, 0.0) for k in range(3)]
    g = spark.createDataFrame(rows, "doc_id long, page int, seq long, char string, x0 double, y0 double")
    g = g.withColumns({"x1": F.col("x0") + 5, "y1": F.col("y0") + 9, "cx": F.col("x0") + 2.5, "cy": F.col("y0") + 4.5, "h_near": F.lit(1).cast("long"), "along": F.when(F.col("seq") % 97 != 5, F.col("x0") + 2.5), "dimension_axis": F.lit("horizontal"), "axis_bucket": (F.col("y0") / 20).cast("int")})
    g = scratch.save(g.withColumn("component", F.min("seq").over(Window.partitionBy("doc_id", "axis_bucket"))), "linked")
    found = scratch.save(registry.ordered(grammar.whole(g)), "groups")
    assert min(r["count"] for r in found.groupBy("stays").count().collect()) > 20
    names = sorted(grammar.groups(chains.split_components(g)).columns) + ["axis_rank", "bucket_first"]
    show = lambda df: sorted(map(str, df.select(names).collect()))
    each = registry.ordered(grammar.groups(chains.split_components(g)))
    assert show(grammar.split(found)) == show(each)
    seen = []
    monkeypatch.setattr(grammar, "split_components", lambda glyphs, keys: seen.append(glyphs.count()) or chains.split_components(glyphs, keys))
    assert show(grammar.split(found.where("stays"))) and not seen
    grammar.split(found)
    assert 0 < seen[0] < len(rows)
