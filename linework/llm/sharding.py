"""Hilbert-curve sharding for multidimensional file pruning, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linework.llm.common import checked_broadcast, join_hot
from linework.sources.scratch import save

#: Bits a dimension; with three dimensions the curve has 4096 cells.
BITS = 4
#: Rows of a part of a cell (by the text's hash), and of a part of a hot group (by the row's number), about.
PART_ROWS, HOT_ROWS = 100_000, 1000
#: A group of equal texts stays whole unless it holds more than this share of a shard's bytes and more than the largest text.
WHOLE = 0.01


def add_hilbert(df: DataFrame, dimensions: list[str], out: str, bits: int = BITS) -> DataFrame:
    """df with column out, the Hilbert index of its whole coordinates under 2**bits (null counts as 0).

    Skilling's transform: undo the rotations from the highest bit down, Gray-code, interleave.  Each step is a column of its own, so that expressions stay short.
    """
    n, names = len(dimensions), [f"__x{i}" for i in range(len(dimensions))]
    df = df.withColumns({x: F.coalesce(F.col(c), F.lit(0)).cast("long") for x, c in zip(names, dimensions, strict=True)})
    long = lambda v: F.lit(v).cast("long")
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i, name in enumerate(names):
            on = F.col(name).bitwiseAND(long(q)) != 0
            swap = F.col(names[0]).bitwiseXOR(F.col(name)).bitwiseAND(long(q - 1))
            df = df.withColumns({"__on": on, "__swap": swap})
            df = df.withColumn(names[0], F.when(F.col("__on"), F.col(names[0]).bitwiseXOR(long(q - 1))).otherwise(F.col(names[0]).bitwiseXOR(F.col("__swap"))))
            if i:
                df = df.withColumn(name, F.when(F.col("__on"), F.col(name)).otherwise(F.col(name).bitwiseXOR(F.col("__swap"))))
    for a, b in zip(names, names[1:], strict=False):
        df = df.withColumn(b, F.col(b).bitwiseXOR(F.col(a)))
    turn = long(0)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = F.when(F.col(names[-1]).bitwiseAND(long(q)) != 0, turn.bitwiseXOR(long(q - 1))).otherwise(turn)
        df = df.withColumn("__turn", turn)
        turn = F.col("__turn")
    index = long(0)
    for b in range(bits - 1, -1, -1):
        for name in names:
            bit = F.shiftrightunsigned(F.col(name).bitwiseXOR(turn), b).bitwiseAND(long(1))
            index = index * 2 + bit
    drop = [*names, "__on", "__swap", "__turn"]
    return df.withColumn(out, index).drop(*drop)


def _levels(groups: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, level) for each value of a column: which of 2**bits equal parts of the rows, in the
    column's order, holds the middle of the value's rows (null first).

    Counts go to ranges of values; a range's start is the sum of those before it, so no task sees more
    than its range.
    """
    counts = groups.groupBy(F.col(column).alias("value")).agg(F.sum("n").alias("n"))
    dealt = save(counts.repartitionByRange("value").withColumn("range", F.spark_partition_id()), "shard-values")
    ranges = dealt.groupBy("range").agg(F.sum("n").alias("rows"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = ranges.select("range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"), F.sum("rows").over(Window.partitionBy(F.lit(0))).alias("total"))
    within = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0)) + F.col("n") / 2
    found = dealt.join(F.broadcast(starts), "range").select("value", F.least(F.floor(middle * (1 << bits) / F.col("total")), F.lit((1 << bits) - 1)).cast("int").alias("level"))
    return save(found, "shard-levels")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source"), bits: int = BITS) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard, curve) per row of docs, by the law 'bytes'.

    Dimensions are the size and the categories, each cut into levels of equal rows over all rows, by
    the whole value.  Rows sort by Hilbert cell; runs of near equal bytes are the shards, so each
    shard's files span a small box of the dimensions.  Equal texts are a group: it sorts at one place
    (the least of its rows' categories) and stays in one shard, unless it holds over WHOLE of a
    shard's bytes and more than the largest text, which unbalances shards as much.

    Positions are sums over cells, then over parts of a cell, then within a part; a hot group has
    parts of its own, by the number that its rows got when they were first saved.  The parts grow in number with the rows, so no window sees more than
    4096 cells, a cell's parts or one part.
    Null texts have size 1 and the CRC of no bytes; null categories sort first; repeated rows each
    get a slot; an empty table gives none; other columns are ignored, so their names can't clash.
    """
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    have = [F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in categories]
    rows = docs.select(F.col(id_col).alias("id"), raw.alias("raw"), *(c.alias(f"c{i}") for i, c in enumerate(have)))
    own = [f"c{i}" for i in range(len(have))]
    slim = rows.select("id", (F.octet_length("raw") + 1).cast("long").alias("size"), F.crc32("raw").alias("crc"), F.xxhash64("raw").alias("th"), F.monotonically_increasing_id().alias("row"), *own)
    slim = save(slim, "shard-rows")
    group, dims = ["th", "crc", "size"], ["size", *own]
    groups = save(slim.groupBy(*group).agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in own)), "shard-groups")
    total, count, largest = (x or 0 for x in groups.agg(F.sum(F.col("n") * F.col("size")), F.sum("n"), F.max("size")).first())
    levels = groups
    for i, d in enumerate(dims):
        known = _levels(groups, d, bits).withColumnRenamed("level", f"d{i}")
        known = checked_broadcast(known, 64)
        levels = levels.join(known, levels[d].eqNullSafe(known["value"])).drop("value")
    placed = add_hilbert(levels, [f"d{i}" for i in range(len(dims))], "curve", bits)
    heavy = F.col("n") * F.col("size") > max(WHOLE * total / shards, largest)
    placed = save(placed.select(*group, "n", "curve", heavy.alias("heavy"), (heavy | (F.col("n") > HOT_ROWS)).alias("hot")), "shard-groups")
    cell_rows = placed.groupBy("curve").agg(F.ceil(F.sum("n") / PART_ROWS).alias("parts"))
    placed = placed.join(F.broadcast(cell_rows), "curve").withColumn("group", F.struct(*group))  # 2 ** (bits * dimensions) rows at most
    # The order: cell, part of the hash, groups that aren't hot and then each hot one, part of the row's number.
    unit = ["curve", "part", "alone", "turn"]
    part = F.pmod("th", F.col("parts"))
    alone = F.when(F.col("hot"), F.col("th"))
    turn = F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / HOT_ROWS))).otherwise(F.lit(0))
    rows = join_hot(slim.select("id", "row", F.struct(*group).alias("group")), placed.drop(*group), "group", count, 96)
    rows = rows.select("id", "row", "group.*", "n", "curve", "heavy", "hot", "parts").select("id", "row", *group, "curve", "heavy", part.alias("part"), alone.alias("alone"), turn.alias("turn"))
    rows = save(rows, "shard-placed")
    units = rows.groupBy(*unit).agg(F.sum("size").alias("b"), F.count("*").alias("k"))
    cells = units.groupBy("curve").agg(F.sum("b").alias("b"), F.sum("k").alias("k"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.sum(c).over(earlier(w)), F.lit(0))
    all_cells = Window.partitionBy(F.lit(0)).orderBy("curve")  # 2 ** (bits * dimensions) rows at most
    cell_at = cells.select("curve", over("b", all_cells).alias("cb"), over("k", all_cells).alias("ck"))
    in_cell = Window.partitionBy("curve").orderBy("part", "alone", "turn")
    unit_at = units.select(*unit, over("b", in_cell).alias("ub"), over("k", in_cell).alias("uk")).join(cell_at, "curve")
    unit_at = unit_at.select(*(F.col(c).alias(f"u_{c}") for c in unit), (F.col("ub") + F.col("cb")).alias("b0"), (F.col("uk") + F.col("ck")).alias("k0"))
    unit_at = unit_at.withColumn("g0", F.min("b0").over(Window.partitionBy("u_curve", "u_part", "u_alone")))
    on = rows["alone"].eqNullSafe(unit_at["u_alone"])
    for c in ("curve", "part", "turn"):
        on &= rows[c] == unit_at[f"u_{c}"]
    joined = rows.join(unit_at, on)
    within = Window.partitionBy(*unit).orderBy("th", "crc", "size", "id", "row")
    whole = Window.partitionBy(*unit, "th", "crc", "size")
    joined = joined.withColumn("at", F.col("b0") + over("size", within)).withColumn("rank", F.col("k0") + F.row_number().over(within) - 1)
    start = F.when(F.col("heavy"), F.col("at")).when(F.col("alone").isNotNull(), F.col("g0")).otherwise(F.min("at").over(whole))
    number = F.least(F.floor(start * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int")
    numbered = save(joined.select("id", "size", "crc", "curve", "rank", number.alias("shard")), "shard-numbered")
    first = numbered.groupBy("shard").agg(F.min("rank").alias("first"))
    out = numbered.join(F.broadcast(first), "shard")  # a row a shard
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
