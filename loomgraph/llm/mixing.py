"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import is_small, settle, small

#: Bins of the rounding's draws, for each source and power of two of the size.
BINS = 256
#: Choices that rounding keeps on its way through a source's sizes.
TRIED = 64
DRAWS = 1 << 40


def source_key(source: str | Column) -> Column:
    """A source's name as a key that joins on null as well; names sort by code point, null last."""
    c = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("0"), c.cast("string")), F.lit("1"))


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Give the sources, in order of ``_key``, weights that repeat ``cycle``. One row a source.

    Keys are dealt out by ranges and numbered within; the ranges' counts, a row each, say how many come before.
    """
    dealt = settle(sources.repartitionByRange("_key").withColumn("_part", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy("_key")) + F.col("_before") - 1
    turn = F.pmod(place, F.lit(len(cycle))).cast("int")
    return dealt.join(F.broadcast(parts), "_part").withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in cycle]), turn)).drop("_part", "_before")


def filled_targets(sources: DataFrame, cap: float) -> DataFrame:
    """Share all sizes among the sources by ``weight``, none above ``cap`` times its own size.

    Each round shares what full sources leave among the others, until no more become full: targets are then
    min(cap * size, level * weight). A round is one sum over the sources.
    """
    most, level, full = cap * F.col("source_size"), 0.0, -1
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    held, heavy, n = 0.0, 0.0, 0
    while n > full and weights and weights > heavy:
        full, level = n, (total - held) / (weights - heavy)
        over = most < level * F.col("weight")
        held, heavy, n = sources.agg(F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(over, F.col("weight"))), F.lit(0.0)), F.count_if(over)).first()
    return sources.withColumn("target", F.least(most, level * F.col("weight")).cast("double"))


def rate_of(cap: float, size: str = "_size", prior: str = "_prior") -> Column:
    """The tilted rate of a document, given its source's multiplier ``lam``; documents without words keep their prior."""
    tilted = F.least(F.lit(cap), F.col(prior) * F.exp(F.col("lam") * F.col(size)))
    return F.when(F.col(prior) <= 0, 0.0).when(F.col(size) == 0, F.least(F.lit(cap), F.col(prior))).when(F.col("target") <= 0, 0.0).otherwise(tilted)


def newton(cells: DataFrame, targets: DataFrame, cap: float, tolerance: float = 1e-8, most: int = 200) -> DataFrame:
    """Solve the dual of entropy balancing: ``_key, target, lam``, one multiplier for each source.

    Minimising sum(rate * (log(rate / prior) - 1)) under sum(size * rate) = target for each source and rate <= cap gives
    rate = min(cap, prior * exp(lam * size)). The dual is convex, its Hessian diagonal, as each document has one source. A
    step needs for each source the tokens taken now and their slope, which Spark sums over ``cells`` (_key, _prior, _size, n:
    documents of equal tilt, counted). Steps are Newton's on the logarithm of the tokens taken, inside a
    bracket that each sum narrows: a step that leaves it is replaced by its middle. A source whose target is all it can
    give has an infinite multiplier. Multipliers are rounded to eleven digits, so that the order in which Spark adds doesn't
    show. Unfinished after ``most`` rounds, it raises.
    """
    rounded = lambda c: F.format_string("%.10e", c).cast("double")
    room = cells.groupBy("_key").agg(F.sum(cap * F.col("n") * F.col("_size")).alias("_room"))
    none, inf = F.lit(None).cast("double"), F.lit(float("inf"))
    known = targets.select("_key", "target").join(room, "_key", "left").withColumn("_room", F.coalesce("_room", F.lit(0.0)))
    spent = (F.col("target") <= 0) | (F.col("target") >= (1 - tolerance) * F.col("_room"))
    state = settle(known.select("_key", "target", F.when(F.col("target") <= 0, 0.0).when(spent, inf).otherwise(0.0).alias("lam"), none.alias("low"), none.alias("high"), spent.alias("done")).repartition(1))
    few = is_small(state)
    for _ in range(most):
        at = state.filter(~F.col("done"))
        rate = F.col("_prior") * F.exp(F.col("lam") * F.col("_size"))
        taken = F.col("n") * F.col("_size") * F.least(rate, F.lit(cap))
        sums = cells.join(F.broadcast(at) if few else at, "_key").groupBy("_key").agg(F.sum(taken).alias("now"), F.sum(F.when(rate < cap, taken * F.col("_size")).otherwise(0.0)).alias("slope"))
        over = F.col("now") > F.col("target")
        moved = state.join(F.broadcast(sums) if few else sums, "_key", "left")
        moved = moved.withColumn("low", F.when(F.col("now").isNotNull() & ~over, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(over, F.col("lam")).otherwise(F.col("high")))
        step = F.when((F.col("now") > 0) & (F.col("slope") > 0), F.col("lam") - F.log(F.col("now") / F.col("target")) * F.col("now") / F.col("slope"))
        inside = step.isNotNull() & (F.col("low").isNull() | (step > F.col("low"))) & (F.col("high").isNull() | (step < F.col("high")))
        outward = F.greatest(F.abs("lam") * 2, F.lit(1e-3))
        middle = F.coalesce((F.col("low") + F.col("high")) / 2, F.when(F.col("low").isNull(), F.col("lam") - outward).otherwise(F.col("lam") + outward))
        shut = F.coalesce(F.col("high") - F.col("low") <= 1e-15 * F.greatest(F.abs("low"), F.abs("high")), F.lit(False))
        ended = F.col("done") | F.coalesce(F.abs(F.col("now") - F.col("target")) <= tolerance * F.greatest("target", F.lit(1.0)), F.lit(True)) | shut
        state = settle(moved.select("_key", "target", F.when(ended, F.col("lam")).otherwise(rounded(F.when(inside, step).otherwise(middle))).alias("lam"), "low", "high", ended.alias("done")).repartition(1), state)
        if state.filter(~F.col("done")).isEmpty():
            return state.select("_key", "target", "lam")
    raise RuntimeError(f"entropy balancing did not end after {most} rounds")


def _walk(cells: pd.DataFrame) -> pd.DataFrame:
    """One source's cuts, from its longest documents down: what rounding leaves over passes on to shorter ones.

    At each power of two the cuts next to what is needed are tried on the best few choices so far; the choice that ends
    nearest to the source's target counts.
    """
    kinds, states = [], [(0.0, ())]
    for kind, own in sorted(cells.groupby("_class"), key=lambda x: -x[0]):
        mass = np.zeros(BINS + 1)
        np.add.at(mass, own["_bin"].to_numpy() + 1, own["_open"].to_numpy())
        given, need = np.cumsum(mass), round(own["_want"].sum() - own["_sure"].sum(), 4)
        steps = np.flatnonzero(np.diff(given, prepend=-1.0))  # bins without documents change nothing
        tried: dict[float, tuple[int, ...]] = {}
        for left, cuts in states:
            near = int(np.searchsorted(given[steps], left + need))
            for cut in steps[max(0, near - 3) : near + 3].tolist():
                tried.setdefault(round(left + need - given[cut], 6), (*cuts, cut))
        kinds.append(kind)
        states = sorted(tried.items(), key=lambda x: (abs(x[0]), x[1]))[:TRIED]
    return pd.DataFrame({"_key": cells["_key"].iloc[0], "_class": kinds, "_cut": states[0][1]})


def _rounding(cap: float) -> dict[str, Column]:
    """Where a document's draw falls: its size's power of two, and the bin of its draw less its rate's fraction."""
    below = (F.col("_draw") / float(DRAWS) - (F.col("_rate") - F.floor("_rate")) + 1) * (BINS / 2)
    return {"_class": F.floor(F.log2(F.greatest(F.col("_size"), F.lit(1)))).cast("int"), "_bin": F.least(F.greatest(F.floor(below), F.lit(0)), F.lit(BINS - 1)).cast("int")}


def _measured(docs: DataFrame, source: str, text: str, prior: str | None) -> dict[str, Column]:
    base = F.lit(1.0) if prior is None else F.coalesce(F.col(prior).cast("double"), F.lit(0.0))
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    return {"_key": source_key(source), "_size": words, "_prior": base, "_draw": F.pmod(F.xxhash64(F.col("doc_id"), F.col(source), F.col(text)), F.lit(DRAWS))}


ADDED = ["size", "source_size", "target", "rate", "copies", "taken"]


def entropy_mix(docs: DataFrame, cap: float = 3.0, cycle: tuple[int, ...] = (1, 2, 3), source: str = "source", text: str = "text", prior: str | None = None, whole: bool = False) -> DataFrame:
    """Return ``doc_id, source, size, source_size, target, rate, copies, taken``: how often a mix takes each row.

    ``size`` counts words of the whole text (null: 0); a null source is a source, the last. ``prior``, if given, names a
    column of positive base rates (null or less: 0, never taken). Rates are the priors tilted by exp(lam * size), with one
    multiplier a source: below its size a source gives up long documents first, above it they come more often. Copies are
    rates rounded by a draw from the row's id, source and text, under a cut for each source and power of two of the size that makes
    sums meet what the rates say; what is left over passes on to shorter documents. Copies depend on the row alone, so ids
    may be null, repeated, or of any type, and rows that agree in id, source and text are taken alike. A source of size 0 has
    target 0. An empty table gives an empty result. With ``whole``, all columns of ``docs`` come back beside the new ones,
    and replace none but those of the same names.
    """
    columns = _measured(docs, source, text, prior)
    slim = settle(docs.select("doc_id", F.col(source).alias("source"), *[c.alias(k) for k, c in columns.items()]))
    cells = settle(slim.filter("_size > 0").groupBy("_key", "_prior", "_size").agg(F.count("*").alias("n")))
    names = slim.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    targets = settle(filled_targets(settle(cycled_weights(names, cycle)), cap))
    solved = settle(targets.select("_key", "source_size").join(newton(cells.filter("_prior > 0"), targets, cap), "_key"))
    solved = small(solved)
    rated = slim.join(solved, "_key").withColumn("_rate", rate_of(cap)).withColumns(_rounding(cap))
    open_ = F.floor("_rate") + 1 <= cap
    counted = rated.filter("_size > 0").groupBy("_key", "_class", "_bin").agg(F.sum(F.when(open_, F.col("_size")).otherwise(0)).cast("double").alias("_open"), F.sum(F.floor("_rate") * F.col("_size")).cast("double").alias("_sure"), F.sum(F.col("_rate") * F.col("_size")).alias("_want"))
    cuts = small(settle(counted.groupBy("_key").applyInPandas(_walk, "_key string, _class int, _cut int")))
    if whole:
        kept = [c for c in docs.columns if c not in ADDED]
        rated = docs.select(F.struct(*kept).alias("_row"), *[c.alias(k) for k, c in columns.items()]).join(solved, "_key").withColumn("_rate", rate_of(cap)).withColumns(_rounding(cap))
        first = [F.col(f"_row.`{c}`").alias(c) for c in kept]
    else:
        first = [F.col("doc_id"), F.col("source")]
    chosen = rated.join(cuts, ["_key", "_class"], "left")
    copies = (F.floor("_rate") + F.when(open_ & (F.col("_bin") < F.coalesce("_cut", F.lit(0))), 1).otherwise(0)).cast("long")
    return chosen.select(*first, F.col("_size").alias("size"), "source_size", "target", F.col("_rate").alias("rate"), copies.alias("copies"), (copies * F.col("_size")).alias("taken"))
