"""The dimension grammar: glyph groups to tokens to dimensions, with higher-order functions.

A token is struct(text, type, ids, stop): its glyphs' seqs and the position of its last glyph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.functions import text as tx
from linework.operators.chains import KEYS, reading_order, split_components, stays_whole
from linework.sources.scratch import save

TOKEN = "struct<text:string,type:string,ids:array<long>>"
FUSED = "struct<text:string,ids:array<long>,grammar_fused:boolean,grammar_rule:string,nominal:double,nominal_text:string,tolerance_value:double,entity_type:string,operator:string,values:array<double>>"


def _let(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _median(values: Column) -> Column:
    """The median of an array of numbers; null of an empty one."""
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return _let(F.array_sort(values), middle)


_NUMERALS = tuple("0123456789.")
#: Gaps that never part digits.
CLOSE = 10.0


def _shifted(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def _steps(a: Column) -> Column:
    """How far each glyph stands from the one before."""
    return F.zip_with(_shifted(a), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.abs(x["along"] - y["along"]))


def _spaced(glyphs: Column) -> Column:
    """Whether a gap is over CLOSE or unknown."""
    return ~F.coalesce(F.forall(_steps(glyphs), lambda s: s <= CLOSE), F.lit(False))


def _one_number(glyphs: Column) -> Column:
    """Whether an ordered array of single characters, none far from the next, has at most one run of digits and points."""
    text = F.array_join(glyphs["char"], "")
    single = F.coalesce(F.forall(glyphs["char"], lambda c: F.length(c) == 1), F.lit(False))
    return single & ~text.rlike(r"(?s)[0-9.][^0-9.].*[0-9.]") & ~_spaced(glyphs)


def tokens(glyphs: Column) -> Column:
    """Tokens of an ordered array of struct(along, seq, char).

    Digits and points run together while the gap between them is usual for the chain (up to CLOSE it always is); every
    other character is a token of its own.
    """
    number = lambda g: g["char"].isin(*_NUMERALS)
    usual = F.when(_spaced(glyphs), F.coalesce(_median(_let(F.filter(glyphs, number), _steps)), F.lit(8.0))).otherwise(0.0)

    def cut(limit: Column) -> Column:
        """Where tokens start, counted from 1."""
        joins = lambda x, y: F.coalesce(number(x) & number(y) & (F.abs(x["along"] - y["along"]) <= limit), F.lit(False))
        ends = F.zip_with(glyphs, _shifted(glyphs), lambda x, y: ~joins(x, y))  # the last has no next one
        return F.filter(F.transform(F.concat(F.array(F.lit(True)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))), lambda new, i: F.when(new, i + 1)), lambda i: i.isNotNull())

    def token(part: Column) -> Column:
        first = F.get(part, F.lit(0))
        text = F.array_join(F.transform(part, lambda g: g["char"]), "")
        return F.struct(text.alias("text"), F.when(number(first), F.lit("number")).otherwise(tx.lexeme(first["char"])).alias("type"), F.transform(part, lambda g: g["seq"]).alias("ids"))

    def made(starts: Column) -> Column:
        parts = F.transform(starts, lambda at, n: F.slice(glyphs, at, F.coalesce(F.get(starts, n + 1), F.size(glyphs) + 1) - at))
        return F.transform(parts, token)

    none = F.array().cast(f"array<{TOKEN}>")
    return F.when(F.size(glyphs) > 0, _let(_let(usual, lambda m: cut(F.greatest(2.5 * m, m + 6.0, F.lit(CLOSE)))), made)).otherwise(none)


def merge_parentheses(found: Column) -> Column:
    """A number before '(' takes every token up to the first ')'; an open one stays alone."""

    def merged(a: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{TOKEN}>").alias("out"), F.lit(-1).alias("skip"))

        def add(acc: Column, i: Column) -> Column:
            t, rest = F.get(a, i), F.slice(a, i + 2, F.size(a))
            close = F.array_position(F.transform(rest, lambda x: tx.strip(x["text"])), ")").cast("int")
            takes = (t["type"] == "number") & F.coalesce(tx.strip(F.get(a, i + 1)["text"]) == "(", F.lit(False)) & (close > 0)
            part = F.slice(rest, 1, F.greatest(close, F.lit(0)))
            whole = F.struct(F.concat(t["text"], F.array_join(F.transform(part, lambda x: x["text"]), "")).alias("text"), F.lit("number").alias("type"), F.concat(t["ids"], F.flatten(F.transform(part, lambda x: x["ids"]))).alias("ids"))
            grown = F.struct(F.concat(acc["out"], F.array(F.when(takes, whole).otherwise(t))).alias("out"), F.when(takes, i + close).otherwise(acc["skip"]).alias("skip"))
            return F.when(i <= acc["skip"], acc).otherwise(grown)

        return F.when(F.size(a) > 0, F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), start, add, lambda x: x["out"])).otherwise(a)

    return _let(found, merged)


def _fused(text, ids, rule, fused=False, nominal=None, nominal_text=None, tolerance=None, kind=None, operator=None, values=None) -> Column:
    null = lambda v, t: F.lit(None).cast(t) if v is None else v
    return F.struct(
        text.alias("text"), ids.alias("ids"), F.lit(fused).alias("grammar_fused"), F.lit(rule).alias("grammar_rule"), null(nominal, "double").alias("nominal"), null(nominal_text, "string").alias("nominal_text"),
        null(tolerance, "double").alias("tolerance_value"), null(kind, "string").alias("entity_type"), null(operator, "string").alias("operator"), null(values, "array<double>").alias("values"),
    )


def _with_tolerance(left: Column, right: Column, ids: Column, rule: str) -> Column:
    """Two texts as 'N ±T' if they are numbers and the tolerance fits, else null; each is read once."""
    number = lambda s: F.struct(s["l"].alias("l"), s["r"].alias("r"), tx.to_double(s["l"]).alias("a"), F.abs(tx.to_double(s["r"])).alias("b"))
    made = lambda v: F.when(v["a"].isNotNull() & v["b"].isNotNull() & tx.tolerance_fits(v["a"], v["b"]), _fused(F.concat(v["l"], F.lit(" ±"), v["r"]), ids, rule, True, v["a"], v["l"], v["b"]))
    return _let(_let(F.struct(left.alias("l"), right.alias("r")), number), made)


def tolerance_triple(n: Column, op: Column, t: Column) -> Column:
    """NUMBER operator NUMBER as one dimension; null if the tolerance doesn't fit."""
    return _with_tolerance(tx.strip(n["text"]), tx.strip(t["text"]), F.concat(n["ids"], op["ids"], t["ids"]), "NUMBER_OPERATOR_NUMBER")


def inline_tolerance(token: Column) -> Column:
    """One token 'N ± T' as a dimension; null if it is none or the tolerance doesn't fit."""
    left, right = (F.regexp_extract(tx.strip(token["text"]), r"^([\d.]+)\s*±\s*([\d.]+)$", i) for i in (1, 2))
    return _with_tolerance(left, right, token["ids"], "INLINE_TOLERANCE")


def nominal_only(token: Column) -> Column:
    text = tx.strip(token["text"])
    return F.when(~tx.is_operator(text) & (tx.is_nominal(text) | tx.is_number_token(text)), _fused(text, token["ids"], "NOMINAL_ONLY"))


def parse(found: Column) -> Column:
    """Dimensions of a token array that has an operator: a scan with two tokens of lookahead."""

    def scanned(a: Column) -> Column:
        start = F.struct(F.array().cast(f"array<{FUSED}>").alias("out"), F.lit(-1).alias("skip"))

        def add(acc: Column, i: Column) -> Column:
            t, op, n = F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)
            is_triple = F.coalesce((t["type"] == "number") & (op["type"] == "operator") & (n["type"] == "number"), F.lit(False))
            inline = (t["type"] == "fused_tolerance") | (t["text"].contains("±") & (t["type"] != "operator"))
            triple = ~inline & is_triple
            one = F.when(inline, inline_tolerance(t)).when(is_triple, tolerance_triple(t, op, n)).when((t["type"] == "number") | t["type"].isin("nominal", "other") & tx.is_nominal(t["text"]), nominal_only(t))

            def added(x: Column) -> Column:
                out = F.when(x.isNotNull(), F.concat(acc["out"], F.array(x))).otherwise(acc["out"])
                return F.struct(out.alias("out"), F.when(triple & x.isNotNull(), i + 2).otherwise(acc["skip"]).alias("skip"))

            return F.when(i <= acc["skip"], acc).otherwise(_let(one, added))

        return F.when(F.size(a) > 0, F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), start, add, lambda x: x["out"])).otherwise(F.array().cast(f"array<{FUSED}>"))

    return _let(found, scanned)


def implicit_pair(a: Column, b: Column) -> Column:
    """Two whole numbers side by side as 'A X B'; null if they are no pair."""

    def read(s: Column) -> Column:
        whole = s["x"].rlike(r"^\d{1,9}$") & s["y"].rlike(r"^\d{1,9}$")
        return F.struct(s["x"].alias("x"), s["y"].alias("y"), F.when(whole, s["x"].try_cast("double")).alias("u"), F.when(whole, s["y"].try_cast("double")).alias("v"))

    def made(s: Column) -> Column:
        u, v = s["u"], s["v"]
        fits = F.coalesce(u.between(1, 499) & v.between(1, 499) & tx.pair_may_form(u, v, s["y"], F.lit(""), F.lit(None).cast("string"), F.size(a["ids"]) + F.size(b["ids"])), F.lit(False))
        return F.when(fits, _fused(F.concat(s["x"], F.lit(" X "), s["y"]), F.concat(a["ids"], b["ids"]), "IMPLICIT_X_BETWEEN_NUMBERS", True, kind=F.lit("SRC_dimension"), operator=F.lit("X"), values=F.array(u, v)))

    return _let(_let(F.struct(tx.strip(a["text"]).alias("x"), tx.strip(b["text"]).alias("y")), read), made)


def dimensions(glyphs: Column, has_operator: Column) -> Column:
    """The dimensions of one ordered glyph group.

    With an operator: what the grammar finds, maybe nothing.  Else the first two numbers as a pair,
    or the whole chain as a string; where there is one number at most, the tokens needn't be read.
    """
    text = tx.strip(F.array_join(F.transform(glyphs, lambda g: g["char"]), ""))
    chain = F.array(_fused(text, F.transform(glyphs, lambda g: g["seq"]), "CHAIN_STRING"))
    none = F.array().cast(f"array<{FUSED}>")

    whole = F.when(text == "", none).otherwise(chain)

    def plain(t: Column) -> Column:
        return _let(F.filter(t, lambda x: x["type"] == "number"), lambda n: _let(implicit_pair(F.get(n, F.lit(0)), F.get(n, F.lit(1))), lambda p: F.when((F.size(n) >= 2) & p.isNotNull(), F.array(p)).otherwise(whole)))

    opens = F.exists(glyphs, lambda g: g["char"] == "(")
    read = _let(_let(tokens(glyphs), lambda t: F.when(opens, merge_parentheses(t)).otherwise(t)), lambda t: F.when(has_operator, parse(t)).otherwise(plain(t)))
    return F.when(~has_operator & _one_number(glyphs), whole).otherwise(read)


def prepared(glyphs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row per prepared glyph group with its ordered glyphs and its place in processing order."""
    comp = [*keys, "dimension_axis", "axis_bucket", "component", "chunk", "piece"]
    order = reading_order(F.col("dimension_axis"), F.col("cx"), F.col("cy"))
    own = F.struct(order.alias("order"), "seq", "along", "char", "x0", "y0", "x1", "y1", "cx", "cy", "h_near")
    return glyphs.groupBy(*comp).agg(F.array_sort(F.collect_list(own)).alias("glyphs"), F.max("has_operator").alias("has_operator"), F.min("seq").alias("first_seq"))


def groups(glyphs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """prepared() with the dimensions of each group, read one by one."""
    return prepared(glyphs, keys).withColumn("found", dimensions(F.col("glyphs"), F.col("has_operator")))


def whole(glyphs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """groups() of components before they are split, with stays: whether one stays whole.  Only those are read here."""
    g = prepared(glyphs.withColumns({"chunk": F.lit(0), "piece": F.lit(0), "has_operator": F.col("char").isin(*tx.OPERATORS)}), keys)
    g = g.withColumn("stays", stays_whole(F.col("has_operator"), F.col("glyphs")))
    return g.withColumn("found", F.when(F.col("stays"), dimensions(F.col("glyphs"), F.col("has_operator"))))


def split(components: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """groups() of whole() components (saved, in order), as split_components parts them: only those that may fall apart are
    glyphs again, and keep where their line begins."""
    stay, rest = (components.where(c) for c in ("stays", "not stays"))
    if rest.isEmpty():
        return components.drop("stays")
    comp = [*keys, "dimension_axis", "axis_bucket", "component"]
    parts = groups(split_components(rest.select(*comp, F.explode("glyphs").alias("g")).select(*comp, "g.*"), keys), keys)
    parts = parts.join(rest.select(*comp, "axis_rank", "bucket_first").distinct().hint("merge"), comp)
    return save(stay.unionByName(parts.withColumn("stays", F.lit(False))).drop("stays"), "split")
