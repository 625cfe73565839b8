"""Graph patterns as DataFrame plans.

A pattern is (subject, predicate, object); terms that start with ``?`` are variables. A query's result has one column for
each variable, without the mark, and one row for each match, as a bag.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Collection, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE
from .compiler import Build

Pattern = tuple[str, str, str]
#: A graph, or what builds the part of it that has some predicates.
Graph = DataFrame | Callable[[list[str]], Build]


def _var(term: str) -> bool:
    return term.startswith("?")


def _single(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """One pattern: filters for its constants, which reach the scan; equal variables become an equality."""
    out, seen = triples, {}
    for c, term in zip("spo", pattern, strict=True):
        if not _var(term):
            out = out.filter(F.col(c) == term)
        elif term in seen:
            out = out.filter(F.col(c) == F.col(seen[term]))
        else:
            seen[term] = c
    return out.select(*[F.col(c).alias(v[1:]) for v, c in seen.items()])


def _star(triples: DataFrame, subject: str, patterns: list[Pattern]) -> DataFrame:
    """Patterns around one subject variable with constant predicates: one scan and one grouping instead of a join each.

    Each predicate's objects are gathered by subject and laid out again, so that repeated values multiply as joins would.
    """
    fixed = [p for p in patterns if not _var(p[2])]
    open_ = [p for p in patterns if _var(p[2])]
    wanted = triples.filter(F.col("p").isin(sorted({p[1] for p in patterns})))
    sums = [F.collect_list(F.when(F.col("p") == p[1], F.col("o"))).alias(f"_v{i}") for i, p in enumerate(open_)]
    sums += [F.max((F.col("p") == p[1]) & (F.col("o") == p[2])).alias(f"_f{i}") for i, p in enumerate(fixed)]
    grouped = wanted.groupBy("s").agg(*sums)
    for i in range(len(fixed)):
        grouped = grouped.filter(f"_f{i}")
    for i in range(len(open_)):
        grouped = grouped.filter(F.size(f"_v{i}") > 0)
    out = grouped.withColumnRenamed("s", subject[1:])
    for i, p in enumerate(open_):
        out = out.withColumn(p[2][1:], F.explode(f"_v{i}"))
    return out.select(subject[1:], *[p[2][1:] for p in open_])


def hubs(triples: DataFrame, most: int = 10_000) -> set[str]:
    """Predicates by which some subject has more than ``most`` objects: one pass to make over a stored graph, for ``match``."""
    counted = triples.groupBy("p", "s").agg(F.count("*").alias("n")).groupBy("p").agg(F.max("n").alias("n"))
    return {r["p"] for r in counted.filter(F.col("n") > most).select("p").collect()}


def _star_of_rows(built: Build, subject: str, patterns: list[Pattern]) -> DataFrame | None:
    """The same of rows that hold triples by subject, if rules leave one kind of object to each predicate: rows are put together, and
    an object that several state is counted once, with no grouping of triples before. A number in front decides nearly all comparisons
    of the sort that lists are gathered by, which names with one beginning don't."""
    rows = built.rows
    codes = {p[1]: rows.coded.codes_of(p[1]) for p in patterns} if rows is not None else {}
    if rows is None or any(_var(p[2]) and codes[p[1]] is None for p in patterns):
        return None
    # A predicate that no rule states has no codes, and no match.
    of = lambda p: F.array_distinct(F.transform(F.filter("_m", lambda x: x["c"].isin(codes[p[1]] or []) & x["o"].isNotNull()), lambda x: x["o"]))
    out = rows.shuffled().groupBy(F.xxhash64("s").alias("_h"), "s").agg(F.flatten(F.collect_list("made")).alias("_m"))
    for p in patterns:
        if not _var(p[2]):
            every = [i for i, x in enumerate(rows.coded.codes) if x[0] == p[1]]
            out = out.filter(F.exists("_m", lambda x: x["c"].isin(every) & (x["o"] == p[2])))  # noqa: B023  called at once
    open_ = [p for p in patterns if _var(p[2])]
    lists = out.select(F.col("s").alias(subject[1:]), *[of(p).alias(f"_v{i}") for i, p in enumerate(open_)])
    # An inner explode has Spark look at arrays' sizes before, and make them for that once more.
    for i, p in enumerate(open_):
        lists = lists.withColumn(p[2][1:], F.explode_outer(f"_v{i}"))
    return lists.select(subject[1:], *[p[2][1:] for p in open_]).dropna()


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two parts that agree. Files are small where triples aren't, so that by Spark's estimate one would be broadcast: they are
    merged, in the order of a number, which decides nearly all comparisons where names that begin alike don't."""
    on = sorted(set(left.columns) & set(right.columns))
    left, right = (x.withColumn("_h", F.xxhash64(*on)) for x in (left, right))
    return left.join(right.hint("merge"), ["_h", *on]).drop("_h")


def _part(triples: Graph, patterns: list[Pattern]) -> DataFrame:
    """One pattern, or several around a subject, over the graph that they look at."""
    looked = triples if isinstance(triples, DataFrame) else triples(sorted({p[1] for p in patterns}))
    if len(patterns) > 1:
        found = None if isinstance(looked, DataFrame) else _star_of_rows(looked, patterns[0][0], patterns)
        return found if found is not None else _star(looked if isinstance(looked, DataFrame) else looked.graph(), patterns[0][0], patterns)
    return _single(looked, patterns[0]) if isinstance(looked, DataFrame) else _single(looked.graph(), patterns[0])


def match(triples: Graph, patterns: Iterable[Pattern], many: Collection[str] = ()) -> DataFrame:
    """All matches of a set of patterns.

    ``triples`` may be a function that builds the graph of some predicates (of rules: ``prune`` them); then each part below makes and
    shuffles what it looks at alone, where it would else look through the whole graph. No predicate may be a variable then.

    Patterns around a subject with distinct object variables are one star; other patterns stand alone. So do those of predicates
    in ``many`` (see ``hubs``): a star gathers a subject's objects in one row, which a subject with very many can't be, while
    a join's skewed keys are split. Parts are joined on what they share, those with more constants first, and never without a
    shared variable.
    """
    stars, parts = defaultdict(list), []
    for p in patterns:
        own = {x[2] for x in stars[p[0]]}
        if _var(p[0]) and not _var(p[1]) and p[1] not in many and p[2] != p[0] and (not _var(p[2]) or p[2] not in own):
            stars[p[0]].append(p)
        else:
            parts.append((_part(triples, [p]), [p]))
    for own in stars.values():
        if own:
            parts.append((_part(triples, own), own))
    weight = lambda part: -sum(not _var(t) for p in part[1] for t in (p[0], p[2]))
    parts.sort(key=weight)
    done, rest = parts[0][0], parts[1:]
    while rest:
        near = next((x for x in rest if set(x[0].columns) & set(done.columns)), None)
        if near is None:
            raise ValueError("the patterns fall apart: no variable joins " + ", ".join(done.columns) + " and the rest")
        rest.remove(near)
        done = done.join(near[0], sorted(set(done.columns) & set(near[0].columns))) if isinstance(triples, DataFrame) else _joined(done, near[0])
    return done


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left matches, with what the right adds where it matches."""
    return left.join(right, sorted(set(left.columns) & set(right.columns)), "left")


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left matches that no right match agrees with."""
    return left.join(right, sorted(set(left.columns) & set(right.columns)), "left_anti")


def union(*parts: DataFrame) -> DataFrame:
    """All parts' matches; variables that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def instances(triples: DataFrame, cls: str, closed: DataFrame) -> DataFrame:
    """``x``: nodes of a class or of one below it, each once. The class's own tree is small and becomes a filter by join."""
    from ..operators.reasoning import dimension

    below = closed.filter(F.col("super") == cls).select(F.col("sub").alias("c")).union(triples.sparkSession.createDataFrame([(cls,)], "c string"))
    types = triples.filter(F.col("p") == RDF_TYPE)
    return types.join(dimension(below), F.col("o") == F.col("c"), "left_semi").select(F.col("s").alias("x")).distinct()


def number(variable: str) -> Column:
    """A variable's value as a number, null where it has none."""
    return F.col(variable).try_cast("decimal(38,10)")


def property_table(triples: DataFrame, predicates: dict[str, str], first_only: bool = False) -> DataFrame:
    """One row a subject, with a column for each named predicate: all its values, sorted, or the smallest alone.

    The predicates are given, so that the grouping is one pass and needs no look at the data for its columns.
    """
    wanted = triples.filter(F.col("p").isin(sorted(predicates.values())))
    value = lambda p: F.when(F.col("p") == p, F.col("o"))
    columns = [(F.min(value(p)) if first_only else F.sort_array(F.collect_set(value(p)))).alias(name) for name, p in predicates.items()]
    return wanted.groupBy("s").agg(*columns)
