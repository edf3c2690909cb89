"""Mixing sources to target weights under a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]. Integrating it gives the source's cumulative token
demand D(t), with D(1) its target; the documents of a source, in hash order, occupy consecutive intervals of tokens,
repeated in passes until the target is reached, and inverting D at the start of an interval gives the training position
of that copy. Documents are then range-sorted by position.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source without tokens
has target 0; an empty table gives an empty result; repeated rows are mixed as separate documents; other columns are
carried along untouched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.plans.runtime import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents a leaf of the prefix-sum tree is sized for.
LEAF_DOCS, ORDER_BITS = 256, 60


def place(key: Column, text: Column, seed: int) -> Column:
    """ORDER_BITS bits by which documents are ordered: of the id and the text, so that rows under one id do not meet."""
    text = F.md5(F.coalesce(text, F.lit("")))
    return F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), text)), F.lit(ORDER_BITS // 4)), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: Sequence[float], cap: float) -> dict:
    """Share the total of sizes by weight; no source above cap times its size, the excess reshared until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    target, open_, left = {}, list(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: float(cap * sizes[s]) for s in over}
        left = max(0.0, left - sum(target[s] for s in over))
        open_ = [s for s in open_ if s not in target]
    return target


def slopes(order: Sequence, slope: float) -> dict:
    """The curriculum: weights of alternate sources rise and fall linearly, 1 - a + 2 a t times their mean."""
    return {s: slope if i % 2 else -slope for i, s in enumerate(order)}


def position(done: Column, target: Column, a: Column) -> Column:
    """t with (1 - a) t + a t^2 = done / target: the inverse of the integrated schedule."""
    x = F.least(F.lit(1.0), F.coalesce(F.try_divide(done, target), F.lit(0.0)))
    root = (F.sqrt((1 - a) * (1 - a) + 4 * a * x) - (1 - a)) / F.when(F.abs(a) < 1e-9, 1.0).otherwise(2 * a)
    return F.when(F.abs(a) < 1e-9, x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), root)))


def curriculum_mix(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: Sequence[str] = (),
    weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, slope: float = 0.5, seed: int = 17, max_sources: int = 100_000,
) -> DataFrame:
    """A row per document: _id, _row (a struct of the columns in carry), _size, _source_size, _target, _copies (an array of pass, position and tokens) and _order; unsorted.

    Only the totals of sources come to the driver; more than max_sources of them is an error. Sources of any size are
    spread over leaves of a two-level tree of prefix sums, so that none is in one task.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(F.col(text_col)).alias("_size"), place(F.col(id_col), F.col(text_col), seed).alias("_order"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("_row"))
    n = docs.count()
    bits = max(0, math.ceil(math.log2(max(1, n / LEAF_DOCS))))
    hi_bits = bits // 2
    src = F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n"))
    # leaves are ranges of the order: its first bits, then the bits after them
    lo = F.shiftright("_order", ORDER_BITS - bits) if bits else F.lit(0).cast("long")
    keyed = docs.withColumns({"_src": src, "_hi": F.shiftright(lo, bits - hi_bits), "_lo": F.pmod(lo, F.lit(1 << (bits - hi_bits)))})
    leaves = materialize(keyed.groupBy("_src", "_hi", "_lo").agg(F.sum("_size").alias("_leaf")), "mix-leaves")
    found = leaves.groupBy("_src").agg(F.sum("_leaf").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {None if r._src == "n" else r._src[1:]: int(r.n) for r in found}
    goal = targets(sizes, weights, cap)
    a = slopes(sorted(s for s in sizes if s is not None) + ([None] if None in sizes else []), slope)
    rows = [("n" if s is None else f"s{s}", sizes[s], goal[s], a[s]) for s in sizes]
    plan = docs.sparkSession.createDataFrame(rows, "_src string, _source_size long, _target double, _slope double")

    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    his = leaves.groupBy("_src", "_hi").agg(F.sum("_leaf").alias("_sum")).withColumn("_off", F.coalesce(F.sum("_sum").over(before("_src").orderBy("_hi")), F.lit(0)))
    offsets = (
        leaves.withColumn("_in", F.coalesce(F.sum("_leaf").over(before("_src", "_hi").orderBy("_lo")), F.lit(0)))
        .join(his.select("_src", "_hi", "_off"), ["_src", "_hi"])
        .join(F.broadcast(plan), "_src")  # at most max_sources rows
        .select("_src", "_hi", "_lo", (F.col("_off") + F.col("_in")).alias("_start"), "_source_size", "_target", "_slope")
    )
    leaf = before("_src", "_hi", "_lo").orderBy("_order", "_id", "_size")
    spread = keyed.join(offsets.hint("merge"), ["_src", "_hi", "_lo"]).withColumn("_start", F.col("_start") + F.coalesce(F.sum("_size").over(leaf), F.lit(0)))
    whole = F.floor(F.col("_target") + 0.5)
    start = lambda p: F.col("_start") + p * F.col("_source_size")
    copies = F.transform(
        F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1)),
        lambda p: F.struct(p.alias("pass"), position(start(p).cast("double"), F.col("_target"), F.col("_slope")).alias("position"), F.greatest(F.lit(0), F.least(F.col("_size"), whole - start(p))).cast("long").alias("tokens")),
    )
    return spread.withColumn("_copies", F.filter(copies, lambda c: c["tokens"] > 0)).drop("_src", "_source", "_hi", "_lo", "_start", "_slope")


def mix_summary(docs: DataFrame, **options) -> DataFrame:
    """One row per document: what the mix takes of it, range-sorted by the position of its first copy."""
    mixed = curriculum_mix(docs, **options)
    taken = F.aggregate("_copies", F.lit(0).cast("long"), lambda s, c: s + c["tokens"])
    out = mixed.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").cast("long").alias("source_size"), F.col("_target").alias("target"),
        taken.alias("taken"), F.round(F.get(F.col("_copies"), F.lit(0))["position"], 9).alias("position"), "_order",
    )
    # documents that are not taken have no position: the hash keeps them from meeting in one range
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "_order").sortWithinPartitions(F.col("position").asc_nulls_last(), "_order").drop("_order")


def schedule(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The training stream: row (a struct of docs' columns), pass, position and tokens of each copy, range-sorted by position.

    The copy that reaches the target is cut to its remaining words, separators before them included.
    """
    columns, text = docs.columns, F.col("_row").getField(text_col)
    mixed = curriculum_mix(docs, text_col=text_col, carry=columns, **options)
    rows = mixed.select("_row", "_size", "_order", F.explode("_copies").alias("_copy"))
    cut = F.regexp_substr(text, F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("_copy.tokens"), F.lit("}+")))
    new = F.when(F.col("_copy.tokens") < F.col("_size"), cut).otherwise(text)
    row = F.struct(*[(new if c == text_col else F.col("_row").getField(c)).alias(c) for c in columns])
    rows = rows.select(row.alias("row"), F.col("_copy.pass").alias("pass"), F.col("_copy.position").alias("position"), F.col("_copy.tokens").alias("tokens"), "_order")
    return rows.repartitionByRange("position", "_order").sortWithinPartitions("position", "_order").drop("_order")


def stream(docs: DataFrame, **options) -> DataFrame:
    """The schedule with docs' own columns only; n_chars, if there is one, counts the text of each copy."""
    rows = schedule(docs, **options).select("row.*")
    if "n_chars" not in docs.columns:
        return rows
    return rows.withColumn("n_chars", F.length(options.get("text_col", "text")).cast(docs.schema["n_chars"].dataType))
