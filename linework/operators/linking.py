"""Components of links within pages, and folds over what belongs together."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.sources.scratch import save

#: Links of a page up to which one task finds its components.
PAGE_LINKS = 1_000_000
#: Rows of a page that one task folds.
FOLDED = 100_000
#: Rows that one call of a fold gets, of many pages together.
BATCH_ROWS = 20_000


def roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least one that it reaches over links left[k] - right[k]."""
    root = np.arange(n)
    while len(left):
        least = np.minimum(root[left], root[right])
        before = root.copy()
        for side in (root[left], root[right], left, right):
            np.minimum.at(root, side, least)
        root = root[root]
        if (root == before).all():
            break
    return root


def _by_page(links: DataFrame, keys: list[str]) -> DataFrame:
    def find(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([rows["u"], rows["v"]]), return_inverse=True)
        found = pd.DataFrame({"node": nodes, "component": nodes[roots(at[: len(rows)], at[len(rows) :], len(nodes))]})
        return found.assign(**dict(zip(keys, key, strict=True)))[[*keys, "node", "component"]]

    schema = links.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).schema
    return links.groupBy(*keys).applyInPandas(find, schema)


def _by_rounds(links: DataFrame, keys: list[str]) -> DataFrame:
    """Each round a node takes the least label about it, then that node's own label, until none changes."""
    both = save(links.union(links.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).union(links.select(*keys, "v", "v")).union(links.select(*keys, "u", "u")).distinct(), "links")
    labels = save(both.groupBy(*keys, F.col("u").alias("node")).agg(F.min("v").alias("component")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "v"), [*keys, "v"]).groupBy(*keys, F.col("u").alias("node")).agg(F.min("component").alias("next"))
        jump = labels.select(*keys, F.col("node").alias("next"), F.col("component").alias("beyond"))
        moved = seen.join(jump, [*keys, "next"]).join(labels, [*keys, "node"])
        moved = save(moved.select(*keys, "node", F.least("next", "beyond").alias("component"), F.col("component").alias("before")), "labels")
        labels = moved.drop("before")
        if moved.where("component <> before").isEmpty():
            return labels


def connected(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component) for the nodes of links(keys, u, v): the least node that each one reaches on its page.

    A page of up to PAGE_LINKS links is one task's; one of more goes through rounds of joins.
    """
    links = save(links.select(*keys, "u", "v"), "links")
    if links.count() <= PAGE_LINKS:
        return _by_page(links, keys)
    large = save(links.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > PAGE_LINKS).select(*keys), "large-pages")
    if large.isEmpty():
        return _by_page(links, keys)
    return _by_page(links.join(large, keys, "left_anti"), keys).union(_by_rounds(links.join(large, keys, "left_semi"), keys))


def fold_pages(rows: DataFrame, keys: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], found: str, parts: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, found) of fold over rows (saved), each page's (or each part's of a page) by themselves; rows whose keys hold
    a null have none.

    fold gets BATCH_ROWS or so of many pages at once, told apart by a number page_no, which it returns with found; it
    puts rows into order itself.
    """
    schema = rows.select(*keys, *(F.lit(None).cast(t).alias(n) for n, t in map(str.split, found.split(", ")))).schema
    by = [*keys, *parts]

    def folded(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.assign(page_no=batch.groupby(by, sort=False).ngroup())
        pages = batch.drop_duplicates("page_no").set_index("page_no")[keys]
        return fold(batch).join(pages, on="page_no")[schema.names]

    rows = rows.dropna(subset=keys)
    batch = F.pmod(F.xxhash64(*by), F.lit(max(1, math.ceil(rows.count() / BATCH_ROWS))))
    return rows.groupBy(batch.alias("batch")).applyInPandas(folded, schema).hint("merge")


def fold_knots(rows: DataFrame, links: DataFrame, keys: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], found: str) -> DataFrame:
    """fold_pages where a page may be of any size.

    Rows of different knots must not matter to each other: those whose node links(keys, u, v) join, directly or
    through others, are one knot.  So a page of more than FOLDED rows is dealt out knot by knot.
    """
    if rows.count() <= FOLDED:
        return fold_pages(rows, keys, fold, found)
    large = save(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > FOLDED), "large-pages")
    if large.isEmpty():
        return fold_pages(rows, keys, fold, found)
    of = rows.join(large, keys).join(connected(links.join(large.select(*keys), keys, "left_semi"), keys).toDF(*keys, "node", "knot"), [*keys, "node"], "left")
    part = F.pmod(F.xxhash64(F.coalesce("knot", "node")), F.ceil(F.col("n") / FOLDED))
    dealt = of.withColumn("part", part).select(*rows.columns, "part").union(rows.join(large, keys, "left_anti").withColumn("part", F.lit(0).cast("long")))
    return fold_pages(save(dealt, "dealt"), keys, fold, found, ["part"])
