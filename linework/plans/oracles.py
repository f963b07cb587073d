"""DuckDB SQL with the rows of the drawing queries."""

from __future__ import annotations

from linework.functions.text import STANDARD_TOLERANCES
from linework.plans.queries import _AT, _CROWD, _CROWD_AT, _FORM, _INLINE, _LONE, _MARKS, _MIXED, _NUMBERS, _PLACE, _READING, HEIGHT, WIDTH


def _annotations(least: int = 0) -> str:
    return f"""a0 AS (SELECT {_PLACE}, cast(floor(value) as bigint)+{least} a, event_type, user_id, ts FROM events),
annot AS (SELECT *, {_AT}, {_FORM} AS text FROM a0)"""


GLYPHS = """glyphs AS (SELECT doc_id, page, event_id, event_id * 32 + i AS seq, substr(text, i, 1) AS char, ax + 6 * (i - 1) AS x0, ay AS y0, ax + 6 * (i - 1) + 5 AS x1, ay + 9 AS y1, ax + 6 * (i - 1) + 2.5e0 AS cx, ay + 4.5e0 AS cy
  FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM annot))"""
DRAWINGS = "drawings AS (SELECT doc_id, page, event_id AS dseq, ax - 4 AS dx0, ay + 12 AS dy0, ax + 40 AS dx1, ay + 12 AS dy1, ax + 18e0 AS dx, ay + 12e0 AS dy FROM annot WHERE event_id % 3 = 0)"
CANDS = """cands AS (SELECT *, event_id AS seq, ax AS x0, ay AS y0, ax + 6 * length(text) - 1 AS x1, ay + 9 AS y1, ax + (6 * length(text) - 1) / 2e0 AS cx, ay + 4.5e0 AS cy, length(text) AS n FROM annot)"""
PIECES = """pieces AS (SELECT event_id, unnest(range(0, 5)) AS nth, unnest([text, right(text, 2), concat('±', b), '+', concat('0', b)]) AS piece FROM annot)"""

NOMINAL = r"(NOT starts_with({0}, '±') AND regexp_matches({0}, '(?i)^R\s*[0-9]|^Ø\s*[0-9]|^[0-9]|°|THK|[0-9]+\.[0-9]+'))"
TYPE = r"""CASE WHEN regexp_matches({0}, '^R\s*[0-9]') THEN 'radius' WHEN contains({0}, 'Ø') OR regexp_matches({0}, '^O\s*[0-9]') THEN 'diameter' WHEN contains({0}, '°') THEN 'angular' WHEN contains({0}, 'THK') THEN 'thickness' WHEN contains({0}, '(REF)') THEN 'reference' ELSE 'linear' END || '_dimension'"""
NOISE = r"""({0} = '' OR regexp_matches({0}, '^[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{2,4}}$|^[0-9]{{1,2}}[./][0-9]{{2}}$|^[0-9]{{5,}}$|^[^(]*\($|^[0-9]+\.\s*$|^[0-9]{{1,2}}[A-Za-z]$|^0[0-9]{{1,2}}$|^0[0-9]{{2,}}$|^[0-9]+[A-Za-z]{{1,4}}$')
 OR (length({0}) >= 7 AND length(regexp_replace({0}, '[^0-9]', '', 'g')) / length({0}) > 0.85))"""


def _valid(t: str) -> str:
    near = " OR ".join(f"abs(abs({t}) - {s}e0) < 0.02e0" for s in STANDARD_TOLERANCES)
    return f"(abs({t}) <= 10 AND ({near} OR (abs({t}) < 1 AND abs(abs({t}) - round_even(abs({t}), 2)) < 0.001e0) OR (abs({t}) BETWEEN 1 AND 4 AND abs(abs({t}) - round(abs({t}))) < 0.001e0)))"


def _fits(n: str, t: str) -> str:
    return f"({t} IS NULL OR ({_valid(t)} AND ({n} IS NULL OR {n} = 0 OR (abs({t}) < abs({n}) AND abs({t}) <= 0.5e0 * abs({n})))))"


def _decimal(v: str) -> str:
    return f"(abs({v} - round_even({v}, 0)) > 1e-6)"


#: Annotations as entities: nominal (num), its text (own), the tolerance (tol) that fits, the type and the display.
ENTITIES = f"""parsed AS (SELECT *, nullif(regexp_extract(text, '±\\s*([0-9.]+)', 1), '') AS tt, regexp_replace(regexp_replace(text, '±\\s*[0-9.]+', ''), '^[RØ]\\s*', '') AS own0 FROM cands),
numbered AS (SELECT *, try_cast(nullif(regexp_extract(own0, '([0-9.]+)', 1), '') AS double) AS num0, try_cast(tt AS double) AS tol0,
  event_id % 8 = 2 AND a > 0 AND a < 5000 AND (a >= 10 OR b >= 10) AS is_pair FROM parsed),
ents AS (SELECT *, CASE WHEN is_pair THEN 'SRC_dimension' ELSE {TYPE.format("text")} END AS kind, CASE WHEN NOT is_pair THEN num0 END AS num,
  CASE WHEN NOT is_pair AND {_fits("num0", "tol0")} THEN tol0 END AS tol,
  CASE WHEN is_pair THEN a || ' X ' || b WHEN starts_with(text, 'R') THEN 'R' || own0 ELSE own0 END AS own FROM numbered),
entities AS (SELECT *, CASE WHEN tol IS NOT NULL THEN own || ' ±' || tt ELSE own END AS display FROM ents)"""
NEAR = """placed AS (SELECT e.seq, dx0, dy0, dx1, dy1, sqrt((cx - dx) * (cx - dx) + (cy - dy) * (cy - dy)) AS gap, row_number() OVER (PARTITION BY e.seq ORDER BY sqrt((cx - dx) * (cx - dx) + (cy - dy) * (cy - dy)), dseq) AS nth
  FROM {0} e JOIN drawings USING (doc_id, page)),
near AS (SELECT {0}.*, coalesce(gap, 'Infinity'::double) AS distance, dx0, dy0, dx1, dy1 FROM {0} LEFT JOIN (SELECT * FROM placed WHERE nth = 1) p USING (seq))"""
MARGIN = f"({{y}} > {HEIGHT}e0 * 0.86e0 OR ({{x}} > {WIDTH}e0 * 0.60e0 AND {{y}} > {HEIGHT}e0 * 0.68e0) OR {{y}} < {HEIGHT}e0 * 0.05e0)"


def _confidence(kind: str, n: str, gap: str, rebuilt: str = "false", isolated: str = "false") -> str:
    return f"""round_even(CASE WHEN {rebuilt} THEN 0.92e0 ELSE 1.0e0 END * CASE WHEN {n} <= 1 THEN 0.45e0 WHEN {n} <= 2 THEN 0.65e0 ELSE 1.0e0 END * CASE WHEN {gap} > 18 THEN 0.35e0 WHEN {gap} > 12 THEN 0.75e0 ELSE 1.0e0 END
 * CASE WHEN {kind} = 'SRC_dimension' AND {gap} > 12 THEN 0.55e0 ELSE 1.0e0 END * CASE WHEN {isolated} THEN 0.4e0 ELSE 1.0e0 END, 3)"""


def _exported(rows: str, margins: bool = True) -> str:
    """rows (with kind, display, num, n, cx, cy, distance) that pass the export rules."""
    return f"""SELECT *, {_confidence("kind", "n", "distance")} AS confidence FROM {rows}
 WHERE NOT (kind = 'thickness_dimension' AND num IS NULL) AND NOT ({NOISE.format("display")} AND kind NOT IN ('SRC_dimension', 'radius_dimension', 'diameter_dimension'))
 AND NOT (kind = 'SRC_dimension' AND distance > 18) AND {_confidence("kind", "n", "distance")} >= 0.35e0 AND upper(display) NOT IN ('THK', '±', '+', '-', 'REF') AND NOT {MARGIN.format(x="cx", y="cy") if margins else "false"}"""


def _sql(*parts: str, least: int = 0) -> str:
    return "WITH " + ",\n".join([_annotations(least), *parts[:-1]]) + "\n" + parts[-1]


#: A region's id counts within its page; rid is its own.
REGIONS = """regions AS (SELECT doc_id, page, slot + wider AS region_id, event_id * 2 + wider AS rid, ax - 42 - wider AS rx0, ay - 30 AS ry0, ax + 182 AS rx1, ay + 81 AS ry1, event_id % 2 = 0 AS by_centre
  FROM annot JOIN (VALUES (0), (1)) v(wider) ON wider = 0 OR slot = 7 WHERE slot IN (7, 28))"""
COUNTS = """counts AS (SELECT g.seq, count(*) FILTER (abs(o.cx - g.cx) > 0 AND abs(o.cx - g.cx) <= 9 AND abs(o.cy - g.cy) <= 4.5) AS h_near, count(*) FILTER (abs(o.cy - g.cy) > 0 AND abs(o.cy - g.cy) <= 16.2e0 AND abs(o.cx - g.cx) <= 2) AS v_near
  FROM glyphs g JOIN glyphs o USING (doc_id, page) GROUP BY 1)"""
AXES = "axes AS (SELECT g.*, h_near, v_near, CASE WHEN v_near >= h_near THEN 'vertical' ELSE 'horizontal' END AS axis FROM glyphs g JOIN counts USING (seq)), lines AS (SELECT *, CASE WHEN axis = 'vertical' THEN cast(round_even(cx / 2.0e0, 0) AS int) ELSE cast(round_even(cy / 4.5e0, 0) AS int) END AS bucket FROM axes)"
GRAMMAR = f"""found AS (SELECT event_id, 0 AS nth,
  CASE k WHEN 1 THEN CASE WHEN ok1 THEN a || ' ±0.' || t ELSE '0.' || t END WHEN 7 THEN CASE WHEN ok7 THEN a || ' ±' || b ELSE b || '' END WHEN 2 THEN CASE WHEN pair THEN a || ' X ' || b ELSE text END ELSE text END AS text,
  CASE WHEN (k = 1 AND ok1) OR (k = 7 AND ok7) THEN 'NUMBER_OPERATOR_NUMBER' WHEN k IN (1, 7) THEN 'NOMINAL_ONLY' WHEN k = 2 AND pair THEN 'IMPLICIT_X_BETWEEN_NUMBERS' ELSE 'CHAIN_STRING' END AS grammar_rule,
  (k = 1 AND ok1) OR (k = 7 AND ok7) OR (k = 2 AND pair) AS grammar_fused, CASE WHEN (k = 1 AND ok1) OR (k = 7 AND ok7) THEN a::double END AS nominal,
  CASE WHEN k = 1 AND ok1 THEN t / 10e0 WHEN k = 7 AND ok7 THEN b::double END AS tolerance_value, CASE WHEN k = 2 AND pair THEN a::double END AS "left", CASE WHEN k = 2 AND pair THEN b::double END AS "right"
  FROM (SELECT *, event_id % 8 AS k, {_fits("a::double", "(t / 10e0)")} AS ok1, {_fits("a::double", "b::double")} AS ok7, a BETWEEN 1 AND 499 AND (a >= 10 OR b >= 10) AS pair FROM annot))"""
#: What a page's chains come to where no number has a single digit: one entity an annotation.
PAGE = f"""g0 AS (SELECT c.*, f.grammar_rule AS rule, f.text AS ftext, f.tolerance_value AS ftol, f.grammar_fused AS fused, c.event_id % 8 AS k FROM cands c JOIN found f USING (event_id)),
g1 AS (SELECT * EXCLUDE (n, x0, cx), CASE WHEN rule = 'NOMINAL_ONLY' THEN length(ftext) WHEN rule = 'IMPLICIT_X_BETWEEN_NUMBERS' THEN n - 1 ELSE n END AS n, CASE WHEN rule = 'NOMINAL_ONLY' THEN ax + 6 * (n - length(ftext)) ELSE ax END AS x0 FROM g0),
g2 AS (SELECT *, (x0 + x1) / 2 AS cx, k = 2 AND (rule = 'IMPLICIT_X_BETWEEN_NUMBERS' OR (a < 5000 AND (a >= 10 OR b >= 10))) AS src FROM g1),
g3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, src, CASE WHEN src THEN least(a, b) END, CASE WHEN src THEN greatest(a, b) END, CASE WHEN NOT src THEN event_id END ORDER BY event_id) AS again FROM g2 WHERE n > 1),
g4 AS (SELECT *, CASE WHEN src THEN 'SRC_dimension' WHEN k = 3 THEN 'radius_dimension' WHEN k = 4 THEN 'reference_dimension' WHEN k = 6 THEN 'thickness_dimension' ELSE 'linear_dimension' END AS kind,
  CASE WHEN src THEN NULL WHEN rule = 'NOMINAL_ONLY' THEN ftext::double WHEN k IN (3, 4, 6) THEN b::double WHEN k = 0 THEN text::double ELSE a::double END AS num, ftol AS tol,
  CASE WHEN src THEN a || ' X ' || b WHEN k = 7 AND fused THEN ftext || '.0' WHEN rule = 'NOMINAL_ONLY' OR k = 1 THEN ftext ELSE text END AS display,
  CASE WHEN src AND rule = 'CHAIN_STRING' THEN 'EXPLICIT_X_OPERATOR' ELSE rule END AS final_rule FROM g3 WHERE again = 1)"""
FULL = (CANDS, GRAMMAR, PAGE, DRAWINGS, NEAR.format("g4"))
FULL_ROWS = f"""SELECT doc_id, page, display AS display_text, kind AS entity_type, num AS nominal, tol AS tolerance, round_even(num - tol, 6) AS "min", round_even(num + tol, 6) AS "max", final_rule AS grammar_rule, 'horizontal' AS orientation,
 n AS glyph_count, round(distance, 6) AS distance, confidence, x0 FROM ({_exported("near")})"""
TOKEN = "SELECT event_id, unnest(range(0, len(m))) AS nth, unnest(m) AS text FROM (SELECT event_id, regexp_extract_all(text, '{0}') AS m FROM annot)"
MODS = "mods AS (SELECT doc_id, page, seq + 1000000000 AS mseq, seq % 5 AS v, x0 + 20 AS mx0, x1 + 20 AS mx1, cx + 20 AS mx, cy AS my, n AS mn FROM cands WHERE event_id % 2 = 0)"
PARENTS = f"""parents AS (SELECT mseq, seq, v, mx0, mx1, mn FROM (SELECT *, row_number() OVER (PARTITION BY mseq ORDER BY sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy)), seq) AS nth FROM mods JOIN entities USING (doc_id, page)
  WHERE num IS NOT NULL AND abs(cy - my) <= 12 AND sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy)) <= 60 AND mx >= cx AND {_fits("num", "v::double")}) WHERE nth = 1)"""

#: The mixed sheets and the rules of links between any two glyphs of a page: font, size, reach along and tolerance across.
MIXED = f"""mixed AS (SELECT *, x0 + 5 AS x1, y0 + 9 AS y1, x0 + 2.5e0 AS cx, y0 + 4.5e0 AS cy FROM (SELECT doc_id, page, {_MIXED} FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM annot) JOIN (VALUES (0), (16)) c(copy) ON copy = 0 OR event_id % 4 = 3)),
tols AS (SELECT doc_id, page, greatest(median(h) * 0.5e0, 2) AS line_tol, greatest(median(w) * 0.35e0, 2) AS col_tol, greatest(median(w) * 1.8e0, 6) AS h_gap, greatest(median(h) * 1.8e0, 6) AS v_gap, greatest(median(h) * 0.35e0, 0.5e0) AS size_tol
  FROM (SELECT *, greatest(x1 - x0, 0.1e0) AS w, greatest(y1 - y0, 0.1e0) AS h FROM mixed) GROUP BY 1, 2),
linked AS (SELECT doc_id, page, a.seq, b.seq AS other, abs(a.cx - b.cx) > 0 AND abs(a.cx - b.cx) <= h_gap AND abs(a.cy - b.cy) <= line_tol AS level, abs(a.cy - b.cy) > 0 AND abs(a.cy - b.cy) <= v_gap AND abs(a.cx - b.cx) <= col_tol AS upright
  FROM mixed a JOIN mixed b USING (doc_id, page, font) JOIN tols USING (doc_id, page) WHERE abs(a.size - b.size) <= size_tol),
near AS (SELECT seq, count(*) FILTER (level) AS h_near, count(*) FILTER (upright) AS v_near FROM linked GROUP BY 1),
mlines AS (SELECT *, CASE WHEN up THEN 'vertical' ELSE 'horizontal' END AS axis, cast(round_even(CASE WHEN up THEN cx / greatest(col_tol, 1) ELSE cy / greatest(line_tol, 1) END, 0) AS int) AS bucket FROM (SELECT *,
  CASE WHEN y1 - y0 > (x1 - x0) * 1.15e0 AND v_near >= h_near THEN true WHEN x1 - x0 > (y1 - y0) * 1.15e0 AND h_near > v_near THEN false ELSE v_near > h_near END AS up FROM mixed JOIN near USING (seq) JOIN tols USING (doc_id, page)))"""
#: A page's chains where each annotation is one: those kept (a pair once a page) in reading order, then the glyphs of no chain.
CHAINS = """pc AS (SELECT *, length(whole) AS n, length(whole) = 1 AS up, min(event_id) OVER (PARTITION BY doc_id, page, length(whole) = 1, CASE WHEN length(whole) = 1 THEN ax ELSE ay END) AS bucket_first,
  row_number() OVER (PARTITION BY doc_id, page, rule, CASE WHEN rule LIKE 'IMPLICIT%' THEN least(a, b) ELSE event_id END, CASE WHEN rule LIKE 'IMPLICIT%' THEN greatest(a, b) END ORDER BY event_id) AS again
  FROM (SELECT doc_id, page, event_id, ax, ay, a, b, annot.text AS whole, found.text, grammar_rule AS rule FROM annot JOIN found USING (event_id))),
kept AS (SELECT *, CASE WHEN rule = 'NOMINAL_ONLY' THEN length(text) WHEN rule LIKE 'IMPLICIT%' THEN n - 1 ELSE n END AS used FROM pc WHERE again = 1),
lost AS (SELECT *, substr(whole, i, 1) AS char FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM pc WHERE rule = 'NOMINAL_ONLY' OR rule LIKE 'IMPLICIT%'))"""
CHAIN_ROWS = """SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY up, bucket_first, event_id) AS seq, text, CASE WHEN used > 1 THEN 'horizontal' WHEN up THEN 'unresolved_vertical_fragment' ELSE 'unresolved_horizontal_fragment' END AS orientation,
 rule AS grammar_rule, used AS glyph_count, CASE WHEN rule = 'NOMINAL_ONLY' THEN ax + 6 * (n - length(text)) ELSE ax END AS x0, ay AS y0 FROM kept
UNION ALL SELECT doc_id, page, 1099511627776 + row_number() OVER (PARTITION BY doc_id, page ORDER BY event_id, i), char, 'unresolved_horizontal_fragment', NULL, 1, ax + 6 * (i - 1), ay FROM lost WHERE CASE WHEN rule = 'NOMINAL_ONLY' THEN i <= length(a::varchar) ELSE char = 'X' END"""
POINTS = "regions AS (SELECT doc_id, page, slot AS region_id, event_id AS rid, ax + 11 - 24 AS rx0, ay + 15 - 24 AS ry0, ax + 11 + 24 AS rx1, ay + 15 + 24 AS ry1, ax + 11 AS px, ay + 15 AS py, false AS by_centre FROM annot WHERE slot % 10 = 3)"
_INSIDE = "CASE WHEN by_centre THEN cx BETWEEN rx0 AND rx1 AND cy BETWEEN ry0 AND ry1 ELSE x0 < rx1 AND x1 > rx0 AND y0 < ry1 AND y1 > ry0 END"
#: What a region's glyphs come to, annotation by annotation: the part of each text inside it, read by the grammar's rules,
#: then the entities, their nearest drawing in the region and the export rules without margins.
CUT = f"""cut AS (SELECT rid, annot.*, c, length(c) AS m FROM (SELECT rid, event_id, string_agg(char, '' ORDER BY seq) AS c FROM glyphs JOIN regions USING (doc_id, page) WHERE {_INSIDE} GROUP BY 1, 2) JOIN annot USING (event_id)),
halves AS (SELECT *, regexp_extract(c, '^([0-9]+)[±X]', 1) AS l, regexp_extract(c, '^[0-9]+[±X](.*)$', 1) AS r FROM cut),
rules AS (SELECT *, CASE WHEN NOT contains(c, '±') THEN CASE WHEN contains(c, 'X') AND r <> '' THEN CASE WHEN l::int < 500 THEN 'IMPLICIT' ELSE 'EXPLICIT' END ELSE 'STRING' END
  WHEN r = '' THEN 'LEFT' WHEN {_fits("l::double", "try_cast(r AS double)")} THEN 'TRIPLE' ELSE 'RIGHT' END AS rule FROM halves),
spans AS (SELECT *, CASE rule WHEN 'LEFT' THEN length(l) WHEN 'RIGHT' THEN length(r) WHEN 'IMPLICIT' THEN m - 1 ELSE m END AS n, CASE rule WHEN 'RIGHT' THEN ax + 6 * (m - length(r)) ELSE ax END AS ex0, CASE rule WHEN 'LEFT' THEN ax + 6 * length(l) - 1 ELSE ax + 6 * m - 1 END AS ex1,
  CASE rule WHEN 'LEFT' THEN l WHEN 'RIGHT' THEN r WHEN 'TRIPLE' THEN l || ' ±' || CASE WHEN r::double = floor(r::double) THEN r::double::bigint || '.0' ELSE r END WHEN 'STRING' THEN c ELSE l || ' X ' || r END AS display,
  CASE WHEN rule IN ('IMPLICIT', 'EXPLICIT') THEN 'SRC_dimension' ELSE {TYPE.format("c")} END AS kind, CASE WHEN rule NOT IN ('IMPLICIT', 'EXPLICIT') THEN 1.0 END AS num FROM rules),
once AS (SELECT *, (ex0 + ex1) / 2 AS cx, ay + 4.5e0 AS cy FROM (SELECT *, row_number() OVER (PARTITION BY rid, kind, CASE WHEN kind = 'SRC_dimension' THEN least(l::int, r::int) ELSE event_id END, CASE WHEN kind = 'SRC_dimension' THEN greatest(l::int, r::int) END ORDER BY event_id) AS again FROM spans) WHERE again = 1 AND n > 1),
drawn AS (SELECT rid, dx, dy, dseq FROM drawings JOIN regions USING (doc_id, page) WHERE dx0 < rx1 AND dx1 > rx0 AND dy0 < ry1 AND dy1 > ry0),
gaps AS (SELECT o.rid, o.event_id, min(sqrt((cx - dx) * (cx - dx) + (cy - dy) * (cy - dy))) AS gap FROM once o JOIN drawn USING (rid) GROUP BY 1, 2),
placed AS (SELECT o.*, coalesce(gap, 'Infinity'::double) AS distance FROM once o LEFT JOIN gaps USING (rid, event_id)),
shown AS ({_exported("placed", margins=False)})"""

#: The crowded sheets, and walks over a page in order that carry what has been taken.
CROWD = f"""a0 AS (SELECT {_CROWD}, cast(floor(value) as bigint) a FROM events), annot AS (SELECT *, {_CROWD_AT}, {_FORM} AS text FROM a0)"""
_SPOT = "(ax::bigint + 6 * (i - 1)) * 10000000 + ay::bigint * 1000 + ascii(substr(whole, i, 1)) % 1000"
ORDER = f"""grp AS (SELECT doc_id, event_id, f.text, grammar_rule AS rule, annot.text AS whole, ax, ay, a, b, "left" FROM annot JOIN found f USING (event_id)),
spots AS (SELECT *, {_SPOT} AS spot, substr(whole, i, 1) AS char, CASE WHEN rule = 'NOMINAL_ONLY' THEN i > length(whole) - length(text) WHEN rule LIKE 'IMPLICIT%' THEN substr(whole, i, 1) <> 'X' ELSE true END AS own FROM (SELECT *, unnest(range(1, length(whole) + 1)) AS i FROM grp)),
steps AS MATERIALIZED (SELECT doc_id, event_id, row_number() OVER (PARTITION BY doc_id ORDER BY event_id) AS nth, list(spot) AS spots, list(spot) FILTER (own) AS own, min(6 * (i - 1)) FILTER (own) + any_value(ax) AS x0, any_value(ay) AS y0, any_value(text) AS text,
  any_value(CASE WHEN rule LIKE 'IMPLICIT%' THEN least(a, b) * 100000 + greatest(a, b) END) AS pair FROM spots GROUP BY 1, 2),
walk AS (SELECT DISTINCT doc_id, 0::bigint AS nth, []::bigint[] AS taken, []::bigint[] AS pairs, '' AS status FROM steps
 UNION ALL SELECT doc_id, nth, CASE WHEN status = 'skipped' THEN taken ELSE list_concat(taken, own) END, CASE WHEN status = 'kept' AND pair IS NOT NULL THEN list_append(pairs, pair) ELSE pairs END, status
  FROM (SELECT w.doc_id, s.nth, taken, own, pairs, pair, CASE WHEN list_has_any(taken, spots) THEN 'skipped' WHEN pair IS NOT NULL AND list_contains(pairs, pair) THEN 'spent' ELSE 'kept' END AS status FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.nth = w.nth + 1)),
ends AS (SELECT doc_id, arg_max(taken, nth) AS taken FROM walk GROUP BY 1)"""
ORDER_ROWS = """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth)::int AS chain_id, text, x0::double AS x0, y0, len(own)::int AS glyph_count FROM walk JOIN steps USING (doc_id, nth) WHERE status = 'kept'
UNION ALL SELECT doc_id, NULL, char, (ax + 6 * (i - 1))::double, ay, 1 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, spot ORDER BY event_id, i) AS again FROM spots JOIN ends USING (doc_id) WHERE NOT list_contains(taken, spot)) WHERE again = 1 AND char NOT IN ('±', '+', '-', '−')"""
PAIRED = f"""nums AS (SELECT {_NUMBERS} FROM events),
besides AS (SELECT *, lead(text) OVER w AS rtext, lead(ax) OVER w AS rx, lead(event_id) OVER w AS rid, min(event_id) OVER (PARTITION BY doc_id, ay) AS line_first FROM nums WINDOW w AS (PARTITION BY doc_id, ay ORDER BY ax, event_id)),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_first, ax, event_id) AS nth, ax::bigint * 10000000 + ay::bigint * 1000 + text::bigint AS ka, rx::bigint * 10000000 + ay::bigint * 1000 + rtext::bigint AS kb, least(text, rtext) || greatest(text, rtext) AS pair
  FROM besides WHERE rx - (ax + 11) > 0 AND rx - (ax + 11) <= 6e0 * 300 / 25.4e0 AND rx - (ax + 11) >= 11 * 0.35e0),
walk AS (SELECT DISTINCT doc_id, 0::bigint AS nth, []::bigint[] AS used, []::varchar[] AS pairs, false AS taken FROM steps
 UNION ALL SELECT doc_id, nth, CASE WHEN free THEN list_concat(used, [ka, kb]) ELSE used END, CASE WHEN free THEN list_append(pairs, pair) ELSE pairs END, free
  FROM (SELECT w.doc_id, s.nth, used, pairs, ka, kb, pair, NOT list_contains(used, ka) AND NOT list_contains(used, kb) AND NOT list_contains(pairs, pair) AS free FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.nth = w.nth + 1))"""
MATCHED = f"""thk AS (SELECT doc_id, event_id AS tid, cx AS tx, cy AS ty, x0 AS tx0, x1 AS tx1, y0 AS ty0 FROM cands WHERE text = 'THK'),
near AS (SELECT thk.doc_id, tid, event_id, sqrt((tx - cx) * (tx - cx) + (ty - cy) * (ty - cy)) AS gap FROM thk JOIN cands USING (doc_id) WHERE text <> 'THK'),
steps AS MATERIALIZED (SELECT doc_id, tid, row_number() OVER (PARTITION BY doc_id ORDER BY tid) AS nth, list(event_id ORDER BY gap, event_id) AS choices FROM near WHERE gap <= 2e0 * 300 / 25.4e0 GROUP BY 1, 2),
walk AS (SELECT DISTINCT doc_id, 0::bigint AS nth, []::bigint[] AS used, NULL::bigint AS pick FROM steps
 UNION ALL SELECT doc_id, nth, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM (SELECT w.doc_id, s.nth, used, list_filter(choices, lambda x: NOT list_contains(used, x))[1] AS pick FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.nth = w.nth + 1)),
bound AS (SELECT event_id, text, x0, x1, y0, tx0, tx1, ty0 FROM walk JOIN steps USING (doc_id, nth) JOIN cands ON event_id = pick JOIN thk USING (tid))"""


def _walk(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


SQL = {
    "q_entity_types": _sql(f"SELECT event_id, text, {TYPE.format('text')} AS entity_type FROM annot"),
    "q_lexemes": _sql(
        PIECES,
        f"""SELECT *, starts_with(piece, '±') AS is_tolerance, piece IN ('±', '+', '-', '−') AS is_operator, {NOMINAL.format("piece")} AS is_nominal, {NOMINAL.format("piece")} OR starts_with(piece, '±') AS is_dimension, regexp_matches(piece, '^[0-9.]+$') AS is_number,
 CASE WHEN piece IN ('±', '+', '-', '−') THEN 'operator' WHEN regexp_matches(piece, '^[0-9.]+$') THEN 'number' WHEN contains(piece, '±') THEN 'fused_tolerance' WHEN {NOMINAL.format("piece")} THEN 'nominal' ELSE 'other' END AS lexeme,
 length(regexp_replace(piece, '[^0-9]', '', 'g')) >= 0.6e0 * length(piece) OR regexp_matches(piece, '(?i)^[RØ±]|THK|°') AS mostly_digits FROM pieces""",
    ),
    "q_noise": _sql(PIECES, f"SELECT *, {NOISE.format('piece')} AS noise, upper(piece) IN ('THK', '±', '+', '-', 'REF') AS orphan FROM pieces"),
    "q_numbers": _sql(
        CANDS, ENTITIES,
        """SELECT event_id, num0 AS nominal, own0 AS nominal_text, tol0 AS tolerance, tt AS tolerance_text, round_even(num0 - tol0, 6) AS least, round_even(num0 + tol0, 6) AS most,
 CASE WHEN num0 = floor(num0) THEN num0::bigint::varchar ELSE a || '.' || t END AS shown FROM numbered""",
    ),
    "q_tolerances": _sql(f"SELECT event_id, a::double AS nominal, b / 4e0 AS tolerance, {_valid('(b / 4e0)')} AS valid, {_fits('a::double', '(b / 4e0)')} AS fits FROM annot"),
    "q_pairs": _sql(
        "p AS (SELECT event_id, (a % 20)::double AS \"left\", b::double / 2 AS \"right\", CASE t WHEN 1 THEN ' nos' WHEN 2 THEN '°' WHEN 3 THEN ' (REF)' ELSE '' END AS tail FROM annot)",
        f"""SELECT *, tail = '°' OR "left" >= 10 OR "right" >= 10 OR {_decimal('"left"')} OR {_decimal('"right"')} AS plausible, (tail = '°' OR (tail = '' AND ("left" >= 10 OR "right" >= 10 OR {_decimal('"right"')}))) AS valid FROM p""",
    ),
    "q_margins": _sql(f"SELECT event_id, {MARGIN.format(x='ax', y='ay')} AS in_margin FROM annot"),
    "q_confidences": _sql(f"SELECT event_id, CASE WHEN slot % 7 <> 0 AND slot % 11 = 0 THEN 0.0 ELSE {_confidence(chr(39) + 'SRC_dimension' + chr(39) + ' = CASE WHEN slot % 3 = 0 THEN ' + chr(39) + 'SRC_dimension' + chr(39) + ' END AND ' + chr(39) + 'SRC_dimension' + chr(39), '(t - 1)', 'b', 'slot % 2 = 0', 'slot % 7 = 0')} END AS confidence FROM annot"),
    "q_envelopes": _sql(GLYPHS, "SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM glyphs GROUP BY 1, 2"),
    "q_coordinates": _sql(CANDS, f"SELECT seq, 4 * ({HEIGHT} - y1) + 3 AS x, 2 * x0 + 5 AS y, 4 * (y1 - y0) AS w, 2 * (x1 - x0) AS h, {HEIGHT} - y1 AS up_y0, {HEIGHT} - y0 AS up_y1, x0 AS back_x0, y0 AS back_y0, x1 AS back_x1, y1 AS back_y1 FROM cands"),
    "q_clipped_glyphs": _sql(GLYPHS, REGIONS, 'SELECT doc_id, page, region_id, count(*) AS n, min(seq) AS "first", max(seq) AS "last" FROM glyphs JOIN regions USING (doc_id, page) WHERE CASE WHEN by_centre THEN cx BETWEEN rx0 AND rx1 AND cy BETWEEN ry0 AND ry1 ELSE x0 < rx1 AND x1 > rx0 AND y0 < ry1 AND y1 > ry0 END GROUP BY 1, 2, 3'),
    "q_point_distances": _sql(
        CANDS, "pts AS (SELECT slot AS point_id, doc_id, page, ax + 11 AS x, ay + 15 AS y FROM annot WHERE slot % 10 = 3)",
        "SELECT doc_id, page, point_id, min(sqrt(greatest(x0 - x, 0, x - x1) ** 2 + greatest(y0 - y, 0, y - y1) ** 2)) AS nearest, min(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) AS centre FROM cands JOIN pts USING (doc_id, page) GROUP BY 1, 2, 3",
    ),
    "q_thresholds": _sql(
        GLYPHS,
        """SELECT doc_id, page, greatest(median(y1 - y0) * 0.5e0, 2.0e0) AS line_tol, greatest(median(x1 - x0) * 0.35e0, 2.0e0) AS col_tol, greatest(median(x1 - x0) * 1.8e0, 6.0e0) AS h_gap_max, greatest(median(y1 - y0) * 1.8e0, 6.0e0) AS v_gap_max,
 greatest(median(y1 - y0) * 0.35e0, 0.5e0) AS size_tol FROM glyphs GROUP BY 1, 2""",
    ),
    "q_neighbors": _sql(GLYPHS, COUNTS, "SELECT * FROM counts"),
    "q_axes": _sql(GLYPHS, COUNTS, AXES, "SELECT seq, axis AS dimension_axis, bucket AS axis_bucket FROM lines"),
    "q_components": _sql(
        GLYPHS, COUNTS, AXES,
        "steps AS (SELECT *, CASE WHEN axis = 'vertical' THEN -cy ELSE cx END AS k FROM lines), gaps AS (SELECT *, k - lag(k) OVER w > CASE WHEN axis = 'vertical' THEN 16.2e0 ELSE 9 END AS cut FROM steps WINDOW w AS (PARTITION BY doc_id, page, axis, bucket ORDER BY k, seq))",
        "isles AS (SELECT *, sum(coalesce(cut, false)::int) OVER (PARTITION BY doc_id, page, axis, bucket ORDER BY k, seq ROWS UNBOUNDED PRECEDING) AS isle FROM gaps)",
        "SELECT seq, CASE WHEN min(k) OVER w = max(k) OVER w THEN seq ELSE min(seq) OVER w END AS component FROM isles WINDOW w AS (PARTITION BY doc_id, page, axis, bucket, isle)",
    ),
    "q_mixed_axes": _sql(
        MIXED,
        """SELECT seq, h_near, v_near, axis AS dimension_axis, bucket AS axis_bucket, CASE WHEN up THEN 'unresolved_vertical_fragment' WHEN h_near > 0 THEN 'unresolved_horizontal_fragment' ELSE 'isolated_glyph' END AS lone, CASE WHEN up THEN 'bottom_to_top' ELSE 'left_to_right' END AS reading FROM mlines""",
    ),
    "q_mixed_components": _sql(
        MIXED,
        "links AS MATERIALIZED (SELECT k.seq, other FROM linked k JOIN mlines a ON a.seq = k.seq JOIN mlines b ON b.seq = other WHERE a.axis = b.axis AND a.bucket = b.bucket AND CASE WHEN a.up THEN upright ELSE level END)",
        "reach AS (SELECT seq, seq AS other FROM mlines UNION SELECT reach.seq, links.other FROM reach JOIN links ON links.seq = reach.other)",
        "SELECT seq, min(other) AS component FROM reach GROUP BY 1",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "q_splits": _sql(
        "SELECT event_id * 32 + i AS seq, (i > 5)::int AS chunk, CASE WHEN event_id % 6 * 4 + 1 - 5 > 12 AND i > 5 THEN cast(floor((i - 6) / 12) AS int) ELSE 0 END AS piece FROM (SELECT event_id, unnest(range(1, event_id % 6 * 4 + 2)) AS i FROM annot)"
    ),
    "q_tokens": _sql(f"SELECT *, CASE WHEN regexp_matches(text, '^[0-9.]+$') THEN 'number' WHEN text = '±' THEN 'operator' ELSE 'other' END AS type FROM ({TOKEN.format('[0-9.]+|[^0-9.]')})"),
    "q_parentheses": _sql(TOKEN.format(r"[0-9.]+\([^)]*\)|[0-9.]+|[^0-9.]")),
    "q_grammar_rules": _sql(GRAMMAR, "SELECT * FROM found"),
    "q_entities": _sql(CANDS, ENTITIES, "SELECT seq, kind AS entity_type, display AS display_text, num AS nominal, own AS nominal_text, tol AS tolerance, CASE WHEN is_pair THEN 'EXPLICIT_X_OPERATOR' ELSE 'CHAIN_STRING' END AS grammar_rule, CASE WHEN is_pair THEN a::double END AS \"left\", CASE WHEN is_pair THEN b::double END AS \"right\" FROM entities"),
    "q_dedupe_pairs": _sql(CANDS, ENTITIES, "SELECT seq, display AS display_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, is_pair, CASE WHEN is_pair THEN least(a, b) ELSE -seq END, CASE WHEN is_pair THEN greatest(a, b) END ORDER BY seq) AS nth FROM entities) WHERE nth = 1"),
    "q_dedupe_best": _sql(
        CANDS, ENTITIES,
        """SELECT doc_id, page, first AS seq, kind AS display_text, n AS glyph_count, own AS nominal_text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, x0, kind ORDER BY (tol IS NOT NULL) DESC, n DESC, seq) AS nth, min(seq) OVER (PARTITION BY doc_id, page, x0, kind) AS first FROM entities) WHERE nth = 1""",
    ),
    "q_nearest_drawings": _sql(CANDS, DRAWINGS, NEAR.format("cands"), "SELECT seq, distance, dx0 AS near_x0, dy0 AS near_y0, dx1 AS near_x1, dy1 AS near_y1 FROM near"),
    "q_nearest_parents": _sql(CANDS, ENTITIES, MODS, PARENTS, "SELECT mseq, seq FROM parents"),
    "q_mixed_parents": _sql(
        CANDS, ENTITIES,
        f"marks AS (SELECT doc_id, page, event_id % 2 = 1 AS mup, event_id % 5 AS v, {_MARKS} FROM cands WHERE event_id % 3 = 0)",
        f"read AS (SELECT *, event_id % 2 = 1 AS up, {_READING} AS o FROM entities)",
        "family AS (SELECT * FROM (VALUES ('horizontal', 'h'), ('unresolved_horizontal_fragment', 'h'), ('rotated', 'h'), ('vertical', 'v'), ('unresolved_vertical_fragment', 'v')) f(name, family))",
        f"""SELECT mseq, seq FROM (SELECT mseq, seq, row_number() OVER (PARTITION BY mseq ORDER BY gap, seq) AS nth FROM (SELECT *, sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy)) AS gap FROM marks JOIN read USING (doc_id, page) LEFT JOIN family fo ON fo.name = o LEFT JOIN family fm ON fm.name = mo
 WHERE num IS NOT NULL AND mup = up AND fo.family IS NOT DISTINCT FROM fm.family AND {_fits("num", "v::double")}) WHERE CASE WHEN up THEN abs(mx - cx) <= 12 AND gap <= 90 AND cy >= my ELSE abs(my - cy) <= 12 AND gap <= 60 AND mx >= cx END) WHERE nth = 1""",
    ),
    "q_attached_modifiers": _sql(
        CANDS, ENTITIES, MODS, PARENTS,
        """SELECT seq, CASE WHEN takes THEN own || ' ±' || v ELSE display END AS display_text, CASE WHEN takes THEN v::double ELSE tol END AS tolerance, CASE WHEN takes THEN n + mn ELSE n END AS glyph_count, CASE WHEN takes THEN greatest(x1, mx1) ELSE x1 END AS x1,
 CASE WHEN takes THEN (least(x0, mx0) + greatest(x1, mx1)) / 2 ELSE cx END AS cx FROM (SELECT e.*, p.*, p.mseq IS NOT NULL AND tol IS NULL AS takes FROM entities e LEFT JOIN (SELECT seq AS pseq, mseq, v, mx0, mx1, mn, row_number() OVER (PARTITION BY seq ORDER BY mseq) AS nth FROM parents) p ON pseq = seq AND nth = 1)""",
    ),
    "q_formed_pairs": _sql(
        """c AS (SELECT doc_id, page, event_id, b::double AS l, t + 11 AS r, ax AS x0, ax + 40 + 6 * length((t + 11)::varchar) - 1 AS x1, 40 - (6 * length(b::varchar) - 1) AS gap, row_number() OVER (PARTITION BY doc_id, page, least(b, t + 11), greatest(b, t + 11) ORDER BY event_id) AS again FROM annot)""",
        "SELECT doc_id, page, l::bigint || ' X ' || r AS text, x0, x1, round_even(greatest(0.55e0, 1 - gap / (6e0 * 300 / 25.4e0) * 0.35e0), 3) AS confidence FROM c WHERE again = 1",
    ),
    "q_bound_thickness": _sql("SELECT event_id AS seq, CASE WHEN event_id % 8 = 5 THEN a || ' THK' ELSE b || 'THK' END AS display_text, ax AS x0, CASE WHEN event_id % 8 = 5 THEN greatest(ax + 29, ax + 6 * length(text) - 1) ELSE ax + 6 * length(text) - 1 END AS x1 FROM annot WHERE event_id % 8 IN (5, 6)"),
    "q_merged_references": _sql(
        CANDS, ENTITIES,
        "r AS (SELECT event_id, a, doc_id, page, ax, ax + 6 * length(text) - 1 AS x1 FROM annot WHERE event_id % 8 = 5)",
        """SELECT doc_id, page, a || '(REF)' AS display_text, a::double AS nominal, 'reference_dimension' AS entity_type, ax AS x0, greatest(x1, ax + 47) AS x1 FROM r
UNION ALL SELECT doc_id, page, display, num, kind, x0, x1 FROM entities WHERE NOT regexp_matches(display, '^[0-9]+([.][0-9]+)?$') AND display NOT IN ('REF', '(REF)') OR (doc_id, page) NOT IN (SELECT (doc_id, page) FROM r)""",
    ),
    "q_stacked_digits": _sql("s AS (SELECT event_id AS doc_id, ay AS y0, ay + 33 AS y1, concat((event_id * 7 + 6) % 10, (event_id * 7 + 3) % 10, (event_id * 7) % 10) AS display_text FROM annot)", "SELECT *, display_text::double AS nominal, 3 AS glyph_count FROM s"),
    "q_inline_tolerances": _sql(
        f"inl AS (SELECT event_id, a, b, t, {_INLINE} AS text FROM annot)",
        f"""SELECT event_id, text, CASE WHEN ok THEN n || ' ±' || v END AS found, CASE WHEN ok THEN 'INLINE_TOLERANCE' END AS grammar_rule, CASE WHEN ok THEN n::double END AS nominal, CASE WHEN ok THEN v::double END AS tolerance_value
 FROM (SELECT *, n <> '' AND {_fits("try_cast(n AS double)", "try_cast(v AS double)")} AS ok FROM (SELECT *, regexp_extract(trim(text), '^([0-9.]+)\\s*±\\s*([0-9.]+)$', 1) AS n, regexp_extract(trim(text), '^([0-9.]+)\\s*±\\s*([0-9.]+)$', 2) AS v FROM inl))""",
    ),
    "q_page_heights": _sql("SELECT event_id, ay + a - t AS height, ay + a - t - (ay + 5) AS y0, ay + a - t - ay AS y1 FROM annot"),
    "q_crowded_order": _walk(CROWD, GRAMMAR, ORDER, ORDER_ROWS),
    "q_crowded_pairs": _walk(PAIRED, "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth)::int AS nth, text || ' X ' || rtext AS text, ax AS x0, rx + 11 AS x1, ay AS y0 FROM walk JOIN steps USING (doc_id, nth) WHERE taken"),
    "q_crowded_matches": _walk(
        f"{CROWD}, lone AS (SELECT * REPLACE ({_LONE} AS text) FROM annot)", CANDS.replace("FROM annot", "FROM lone"), MATCHED,
        "SELECT event_id AS seq, text || ' THK' AS display_text, least(x0, tx0) AS x0, greatest(x1, tx1) AS x1, least(y0, ty0) AS y0, greatest(y0, ty0) + 9 AS y1 FROM bound",
    ),
    "q_exported": _sql(CANDS, ENTITIES, DRAWINGS, NEAR.format("entities"), f"SELECT seq, display AS display_text, confidence FROM ({_exported('near')})"),
    "q_flattened_pages": _sql(GLYPHS, "SELECT doc_id, page, count(*) AS n, sum(x0) AS x, count(*) AS places, string_agg(char, '' ORDER BY seq) AS text FROM glyphs GROUP BY 1, 2"),
    "q_bursts": _sql(
        "cuts AS (SELECT *, ts >= lag(ts) OVER w + INTERVAL 1 HOUR AS cut FROM annot WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
        "runs AS (SELECT *, sum(coalesce(cut, false)::int) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM cuts)",
        "SELECT user_id AS client, max(event_id) AS request_id, arg_max(ax, event_id) AS x, arg_max(ay, event_id) AS y FROM runs GROUP BY user_id, run",
    ),
    "q_full_page": _sql(*FULL, FULL_ROWS, least=10),
    "q_page_chains": _sql(CANDS, GRAMMAR, CHAINS, CHAIN_ROWS),
    "q_region_extract": _sql(
        GLYPHS, DRAWINGS, REGIONS, CUT,
        f"""SELECT region_id, doc_id, page, rx0 AS x0, ry0 AS y0, rx1 AS x1, ry1 AS y1, {WIDTH}e0 AS page_width, {HEIGHT}e0 AS page_height, coalesce(n, 0)::bigint AS entity_count, coalesce(texts, '') AS texts
 FROM regions LEFT JOIN (SELECT rid, count(*) AS n, string_agg(display, '|' ORDER BY event_id) AS texts FROM shown GROUP BY 1) USING (rid)""",
        least=10,
    ),
    "q_snap": _sql(
        GLYPHS, DRAWINGS, POINTS, CUT,
        "boxed AS (SELECT s.*, sqrt(greatest(ex0 - px, 0, px - ex1) ** 2 + greatest(ay - py, 0, py - (ay + 9)) ** 2) AS d FROM shown s JOIN regions USING (rid))",
        """SELECT region_id AS point_id, doc_id, page, coalesce(n, 0)::bigint AS candidate_count, display AS display_text, round_even(d, 3) AS snap_distance
 FROM regions LEFT JOIN (SELECT rid, count(*) AS n, arg_min(display, d) AS display, min(d) AS d FROM boxed GROUP BY 1) USING (rid)""",
        least=10,
    ),
    "q_page_summary": _sql(*FULL, f'SELECT doc_id, entity_type, count(*) AS n, sum(tolerance) AS tolerances, max("max") AS most FROM ({FULL_ROWS}) GROUP BY 1, 2', least=10),
}
