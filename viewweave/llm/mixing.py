"""Mixing sources to target weights: hierarchical budgeting over a domain > language > source tree.

Native: DataFrame functions only. A leaf supplies its tokens once an epoch, up to max_epochs. The total budget goes down the
tree by weight; a child that cannot supply its share leaves the shortage to its siblings (by their weights), and only what a
whole subtree cannot supply reaches the parent's siblings. Each leaf gives the prefix of its documents, epoch by
epoch, in an order seeded by epoch and document (the MD5 of seed, epoch and id), until its budget is met.

Scale: supplies are partial sums by leaf. Whole epochs need no order. In a leaf's last epoch the document at which the budget ends is
found by descent: sums by the next digits of the order's key within the one range that is still open, DEPTH times, each a few rows a
leaf; only documents that share all these digits are ranked row by row. So a leaf with a third of all rows is never one task's
window. The leaf table is broadcast only when counted; else adaptive execution splits skewed leaves in a sort-merge join.

Cases: null domain, language or source are a node of their own; a null or empty text has 0 tokens, takes no budget and is
taken while its leaf is still open; rows with the same id have one place in the order and are taken together or not at all; a leaf
of no tokens gets nothing; weights that are missing are 1; children of equal cap and weight get equal budgets; a budget of null means
`fraction` of the supply of one epoch; an empty table gives an empty result; other columns are kept under their names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, materialise, sized_join

DIGITS, DEPTH = 2, 3  # hexadecimal digits of a step of the descent, and its steps
LEVELS = ("domain", "lang", "source")


def waterfill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds `budget` to nodes (LEVELS, weight, cap, parent_budget): min(cap, level * weight), with the level that spends the parent's budget."""
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("weight")).asc(), *LEVELS)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*parent)
    cap_before, weight_before = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.col("parent_budget") - cap_before) / (F.sum("weight").over(every) - weight_before)
    # the first child, in order of cap / weight, that its level does not fill sets the level for it and all after it
    ranked = nodes.withColumn("level", level).withColumn("nth", F.row_number().over(order))
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("nth", "level"))).over(every)
    opened = ranked.withColumn("open", first.getField("level"))
    return opened.withColumn("budget", F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("open") * F.col("weight")))).drop("level", "nth", "open")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, float], budget: float | None, fraction: float, max_epochs: int) -> DataFrame:
    """Budgets in tokens for leaves (LEVELS, supply). weights: by path 'domain', 'domain/lang' or 'domain/lang/source'."""
    table = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v)))) if weights else None

    def weight(path: Column) -> Column:
        return F.coalesce(F.try_element_at(table, path), F.lit(1.0)) if table is not None else F.lit(1.0)

    name = lambda c: F.coalesce(F.col(c), F.lit("null"))
    stock = leaves.withColumn("cap", F.col("supply").cast("double") * max_epochs)
    whole = stock.agg(F.coalesce(F.sum("cap"), F.lit(0.0)).alias("c"), F.coalesce(F.sum("supply"), F.lit(0)).alias("s")).first()
    total = min(whole.c, float(whole.s) * fraction if budget is None else float(budget))
    level: DataFrame | None = None
    for depth in (1, 2, 3):
        keys = list(LEVELS[:depth])
        nodes = stock.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
        for extra in LEVELS[depth:]:
            nodes = nodes.withColumn(extra, F.lit(None).cast("string"))
        nodes = nodes.withColumn("weight", weight(F.concat_ws("/", *(name(k) for k in keys)))).where("cap > 0 and weight > 0")
        if level is None:
            level = waterfill(nodes.withColumn("parent_budget", F.lit(total)).withColumn("root", F.lit(0)), ["root"])
        else:
            above = level.select(*(F.col(k).alias(f"{k}_up") for k in keys[:-1]), F.col("budget").alias("parent_budget"))
            same = [F.col(k).eqNullSafe(F.col(f"{k}_up")) for k in keys[:-1]]
            joined = nodes.join(above, same, "inner").drop(*(f"{k}_up" for k in keys[:-1]))
            level = waterfill(joined, keys[:-1])
    return level.select(*LEVELS, "supply", "budget")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def last_places(rows: DataFrame, leaves: DataFrame, max_epochs: int, place) -> DataFrame:
    """(leaf, full, last): how many epochs a leaf gives whole, and the last place in the next that its budget reaches (null: none).

    rows are (leaf, id, tokens), leaves (leaf, supply, budget).
    """
    ends = leaves.withColumn("full", F.floor(F.col("budget") / F.col("supply")).cast("int"))
    ends = materialise(ends.select("leaf", "full", F.floor(F.col("budget") - F.col("full") * F.col("supply")).alias("rest"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before")))
    partial = sized_join(rows, ends.where(F.col("full") < max_epochs).select("leaf", "full"), ["leaf"], "inner")
    placed = materialise(partial.select("leaf", place(F.col("full"), F.col("id")).alias("place"), "tokens"))
    opened = ends
    for step in range(1, DEPTH + 1):
        inside = sized_join(placed, opened.select("leaf", "prefix"), ["leaf"], "inner").where(F.startswith("place", "prefix"))
        sums = inside.groupBy("leaf", F.substring("place", 1, DIGITS * step).alias("next")).agg(F.sum("tokens").alias("n"))
        ahead = Window.partitionBy("leaf").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
        along = sums.join(opened, "leaf").withColumn("so_far", F.col("before") + F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        found = along.where("so_far <= rest").groupBy("leaf", "full", "rest").agg(F.max(F.struct("next", "so_far")).alias("e"))
        opened = materialise(found.select("leaf", "full", "rest", F.col("e.next").alias("prefix"), F.col("e.so_far").alias("before")))
    inside = sized_join(placed, opened, ["leaf"], "inner").where(F.startswith("place", "prefix"))
    upto = Window.partitionBy("leaf").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(upto)).where("upto <= rest").groupBy("leaf").agg(F.max("place").alias("reached"))
    # where the range's first document is too much, everything before the range is taken
    last = opened.join(reached, "leaf", "left").select("leaf", F.coalesce("reached", "prefix").alias("last"))
    out = materialise(ends.join(last, "leaf", "left").select("leaf", "full", "last"))
    discard(placed)
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: float | None = None, fraction: float = 1.0, max_epochs: int = 4, seed: int = 17, domain: Column | None = None, lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """The selected rows of a stored table, once for each epoch that takes them, and, as the last column, a struct: epoch, domain, lang, source.

    It is called mix, or, where docs has that name, mix with underscores behind it.
    """
    n = F.coalesce(tokens, F.lit(0)).cast("long") if tokens is not None else count_words(F.col(text_col))
    dom = (domain if domain is not None else F.lit("all")).cast("string")
    leaf_of = F.struct(dom.alias("domain"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    place = lambda epoch, key: F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(key.cast("string"), F.lit(""))))
    narrow = materialise(docs.select(leaf_of.alias("leaf"), F.col(id_col).alias("id"), n.alias("tokens")))
    supply = materialise(narrow.groupBy("leaf").agg(F.sum("tokens").alias("supply")).select("leaf.*", "supply"))
    budgets = leaf_budgets(supply, weights or {}, budget, fraction, max_epochs).select(F.struct(*LEVELS).alias("leaf"), "supply", "budget")
    ends = last_places(narrow, budgets, max_epochs, place)
    leaf, epoch, mix = (fresh(x, docs.columns) for x in ("leaf", "epoch", "mix"))
    ends = ends.select(F.col("leaf").alias(leaf), F.col("full").alias(f"{leaf}_full"), F.col("last").alias(f"{leaf}_last"))
    whole, last = F.col(f"{leaf}_full"), F.col(f"{leaf}_last")
    taken = sized_join(docs.withColumn(leaf, leaf_of), ends, [leaf], "inner")
    taken = taken.withColumn(epoch, F.explode(F.sequence(F.lit(0), F.least(whole, F.lit(max_epochs - 1)))))
    taken = taken.where((F.col(epoch) < whole) | (place(F.col(epoch), F.col(id_col)) <= last))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns), F.struct(F.col(epoch).alias("epoch"), *(F.col(f"{leaf}.{c}").alias(c) for c in LEVELS)).alias(mix))
