"""Regular paths: which nodes are joined by links whose predicates spell a word of a pattern.

A pattern is made of predicates by functions: ``alt(plus(seq("a", "b")), inverse("c"))`` is one or more times a then b, or c
backwards. It becomes an automaton of a state for each of its predicates; the graph is searched along with it, in rounds that extend
what the last round found, and that end as no pair of node and state is searched twice from one start.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import fresh, settle

#: Rounds that are kept apart before they are put together into one table.
APART = 16


@dataclass(frozen=True)
class Path:
    """A pattern, as the automaton that it is: ``steps`` are (predicate, backwards) of states 1, 2, ...; a state is entered over its step.

    ``first`` and ``last`` are the states that a word may begin and end with, ``follow`` the pairs that may stand side by side, and
    ``empty`` says whether the pattern has the word of no steps.
    """

    steps: tuple[tuple[str, bool], ...] = ()
    first: frozenset[int] = frozenset()
    last: frozenset[int] = frozenset()
    follow: frozenset[tuple[int, int]] = field(default=frozenset())
    empty: bool = False

    def _moved(self, by: int) -> Path:
        up = lambda states: frozenset(x + by for x in states)
        return replace(self, first=up(self.first), last=up(self.last), follow=frozenset((a + by, b + by) for a, b in self.follow))

    def reverse(self) -> Path:
        """The pattern of the same ways, walked from their ends."""
        return Path(tuple((p, not back) for p, back in self.steps), self.last, self.first, frozenset((b, a) for a, b in self.follow), self.empty)


Pattern = Path | str


def one(pattern: Pattern) -> Path:
    """A predicate's link, or a pattern as it is."""
    return pattern if isinstance(pattern, Path) else Path(((pattern, False),), frozenset({1}), frozenset({1}))


def inverse(pattern: Pattern) -> Path:
    """Backwards."""
    return one(pattern).reverse()


def seq(*patterns: Pattern) -> Path:
    """One after another."""
    out = Path(empty=True)
    for p in patterns:
        new = one(p)._moved(len(out.steps))
        joined = frozenset((a, b) for a in out.last for b in new.first)
        out = Path(out.steps + new.steps, out.first | new.first if out.empty else out.first, out.last | new.last if new.empty else new.last, out.follow | new.follow | joined, out.empty and new.empty)
    return out


def alt(*patterns: Pattern) -> Path:
    """Any of some."""
    out = Path()
    for p in patterns:
        new = one(p)._moved(len(out.steps))
        out = Path(out.steps + new.steps, out.first | new.first, out.last | new.last, out.follow | new.follow, out.empty or new.empty)
    return out


def plus(pattern: Pattern) -> Path:
    """Once or more."""
    p = one(pattern)
    return replace(p, follow=p.follow | frozenset((a, b) for a in p.last for b in p.first))


def optional(pattern: Pattern) -> Path:
    """Once or not at all."""
    return replace(one(pattern), empty=True)


def star(pattern: Pattern) -> Path:
    """Any number of times."""
    return optional(plus(pattern))


def edges_of(triples: DataFrame, path: Path) -> DataFrame:
    """``a, b, step``: the links that a pattern walks, in its direction, each once. Steps are numbers of (predicate, backwards)."""
    numbers = {step: i for i, step in enumerate(dict.fromkeys(path.steps))}
    wanted = triples.filter(F.col("p").isin(sorted({p for p, _ in numbers})))
    ways = [F.when((F.col("p") == p), F.struct(F.col("o" if back else "s").alias("a"), F.col("s" if back else "o").alias("b"), F.lit(i).alias("step"))) for (p, back), i in numbers.items()]
    found = wanted.select(F.explode(F.array(*ways)).alias("e")).filter("e is not null").select("e.*")
    return found.distinct()


def _moves(spark, path: Path) -> DataFrame:
    """``state, step, next``: the automaton, of which the driver holds the few rows. State 0 is the beginning."""
    numbers = {step: i for i, step in enumerate(dict.fromkeys(path.steps))}
    pairs = [(0, x) for x in sorted(path.first)] + sorted(path.follow)
    return F.broadcast(spark.createDataFrame([(a, numbers[path.steps[b - 1]], b) for a, b in pairs], "state int, step int, next int"))


class Seen:
    """Settled rounds of rows that are told apart by some columns; every ``APART`` rounds they are put together."""

    def __init__(self, first: DataFrame, keys: list[str]):
        self.keys, self.rounds = keys, [settle(first)]

    @property
    def last(self) -> DataFrame:
        return self.rounds[-1]

    def all(self) -> DataFrame:
        out = self.rounds[0]
        for r in self.rounds[1:]:
            out = out.union(r)
        return out

    def add(self, found: DataFrame) -> bool:
        """Keep of the rows found those that are new, and say whether there are any."""
        new = settle(found.join(self.all().select(*self.keys), self.keys, "left_anti"))
        if new.isEmpty():
            return False
        if len(self.rounds) >= APART:
            self.rounds = [settle(self.all())]
        self.rounds.append(new)  # the last round stays apart: it alone is extended
        return True


def _stepped(last: DataFrame, edges: DataFrame, moves: DataFrame) -> DataFrame:
    """One step on. The automaton has few rows, so that its join is a look-up; the links are met by node and step."""
    open_ = last.join(moves, "state").select("start", F.col("node").alias("a"), "step", "next")
    return open_.join(edges, ["a", "step"]).select("start", F.col("b").alias("node"), F.col("next").alias("state")).distinct()


def _search(first: DataFrame, edges: DataFrame, moves: DataFrame, most: int, keep: Callable[[DataFrame], DataFrame] = lambda step: step) -> Seen:
    """All ``start, node, state`` that are reached from the first ones, by steps of which ``keep`` may leave some out."""
    seen = Seen(first, ["start", "node", "state"])
    if seen.last.isEmpty():
        return seen
    for _ in range(most):
        if not seen.add(keep(_stepped(seen.last, edges, moves))):
            return seen
    raise RuntimeError("the paths did not end after the rounds that they may take")


#: First places from which a walk may go on, for one start, where places are reached by one way each.
BRANCHES = 2


def _one_way(edges: DataFrame, moves: DataFrame, first: DataFrame) -> bool:
    """Whether every place (node and state) that leads on is come to from one place at most, and no start begins by more than ``BRANCHES``
    such places. Then no walk meets another of its start's but in places that lead nowhere, or along a stretch that the other began with."""
    inner = edges.join(moves.filter("state <> 0"), "step")
    onward = inner.select(F.col("a").alias("node"), "state").distinct()
    into = inner.groupBy(F.col("b").alias("node"), F.col("next").alias("state")).agg(F.count("*").alias("n")).filter("n > 1")
    if not into.join(onward, ["node", "state"], "left_semi").isEmpty():
        return False
    begun = first.join(onward, ["node", "state"], "left_semi").groupBy("start").agg(F.count("*").alias("n"))
    return begun.filter(F.col("n") > BRANCHES).isEmpty()


def _walks(first: DataFrame, edges: DataFrame, moves: DataFrame, most: int) -> DataFrame:
    """All ``start, node, state`` of walks where ``_one_way`` holds; some may come twice. Nodes are numbers.

    A walk can only come back to the place that it began with, which it carries, so that no round looks at what others found. Links lie
    in buckets by what they are joined on, and only the last round's ends are shuffled.
    """
    spark = edges.sparkSession
    base, name, n = fresh(spark, "walks"), f"loomgraph_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "start long, node long, state int, began long, began_state int"
    first.select("start", "node", "state", F.col("node").alias("began"), F.col("state").alias("began_state")).write.parquet(f"{base}/0")
    edges.repartition(n, "a", "step").write.bucketBy(n, "a", "step").option("path", fresh(spark, "links")).saveAsTable(name)
    try:
        for k in range(1, most + 1):
            open_ = spark.read.schema(schema).parquet(f"{base}/{k - 1}").join(moves, "state").withColumnRenamed("node", "a").drop("state")
            onward = open_.join(spark.table(name), ["a", "step"]).select("start", F.col("b").alias("node"), F.col("next").alias("state"), "began", "began_state")
            onward.filter((F.col("node") != F.col("began")) | (F.col("state") != F.col("began_state"))).write.parquet(f"{base}/{k}")
            if spark.read.schema(schema).parquet(f"{base}/{k}").isEmpty():
                return spark.read.schema(schema).parquet(*[f"{base}/{i}" for i in range(k)]).select("start", "node", "state")
    finally:
        spark.sql(f"DROP TABLE {name}")
    raise RuntimeError("the paths did not end after the rounds that they may take")


def _place(states: int) -> Column:
    """The number of a node and a state."""
    return F.col("node") * states + F.col("state")


def _mains(first: DataFrame, states: int) -> DataFrame:
    """``start, main``: of the places that a start's first step leads to, the one that most starts come to, if it isn't this start's alone."""
    many = first.groupBy("node", "state").agg(F.count("*").alias("n")).filter("n > 1")
    return first.join(many, ["node", "state"]).groupBy("start").agg(F.max(F.struct("n", _place(states).alias("main")))["main"].alias("main"))


def _others(pairs: DataFrame, mains: DataFrame, shared: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that their start's main place doesn't give already."""
    known = shared.select(F.col("start").alias("main"), *keys)
    return pairs.join(mains, "start", "left").join(known, ["main", *keys], "left_anti").select(*pairs.columns)


#: Pairs of starts and nodes that are made in one group, and in about one task; the most tasks to be asked for, and starts in about one list.
GROUP, TASK, MOST_PARTS, LIST = 1 << 22, 1 << 24, 1 << 16, 1 << 10


def _product(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """``start, node``: each of ``starts`` (main, start) with each of ``ends`` (main, node) of the same main place.

    The rows made may be many more than those read, and a place may have any number of either: a place's nodes are dealt to groups, each
    of which has all its starts and makes about ``GROUP`` rows, and groups to as many tasks as the rows made ask for. Starts come in lists,
    as a list's rows are made faster than a join's.
    """
    count = lambda df, n: df.groupBy("main").agg(F.count("*").cast("double").alias(n))
    sizes = settle(count(starts, "n").join(count(ends, "m"), "main").select("main", (F.col("n") * F.col("m")).alias("made"), F.least(F.col("m"), F.ceil(F.col("n") * F.col("m") / GROUP)).cast("int").alias("groups"), F.ceil(F.col("n") / LIST).cast("int").alias("lists")))
    made = sizes.agg(F.sum("made")).first()[0] or 0.0
    parts = max(int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, int(made / TASK) + 1))
    left = ends.join(sizes, "main").select("main", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int").alias("group"), "node").repartition(parts, "main", "group")
    lists = starts.join(sizes, "main").groupBy("main", "groups", F.pmod(F.xxhash64("start"), F.col("lists")).alias("list")).agg(F.collect_list("start").alias("starts"))
    right = lists.select("main", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "starts").repartition(parts, "main", "group")
    # By Spark's estimate neither side is large, and one would be broadcast whole.
    return left.join(right.hint("merge"), ["main", "group"]).select(F.explode("starts").alias("start"), "node")


def reach(triples: DataFrame, pattern: Pattern, starts: DataFrame | None = None, ends: DataFrame | None = None, most: int = 10_000) -> DataFrame:
    """``start, node``: pairs of nodes that a way of the pattern joins, each once.

    With ``starts`` (node) only ways from these are walked; with ``ends`` alone ways are walked from their ends. Without either, from
    every node that a first step leaves; if the pattern has the word of no steps, every subject and object reaches itself (with
    ``starts`` or ``ends``, these). Cycles end. Unfinished after ``most`` rounds, it raises.
    """
    path = one(pattern)
    if starts is None and ends is not None:
        back = reach(triples, path.reverse(), ends, None, most)
        return back.select(F.col("node").alias("start"), F.col("start").alias("node"))
    spark = triples.sparkSession
    edges, moves = settle(edges_of(triples, path)), _moves(spark, path)
    if starts is not None:
        begun = starts.select("node").filter("node is not null").distinct()
    else:
        begun = edges.join(moves.filter("state = 0"), "step", "left_semi").select(F.col("a").alias("node")).distinct()
    own = None
    if path.empty:
        own = starts.select("node").filter("node is not null") if starts is not None else triples.filter("o_kind <> 'literal'").select(F.explode(F.array("s", "o")).alias("node")).union(triples.select("s"))
        own = own.select(F.col("node").alias("start"), "node")
    ended = F.col("state").isin(sorted(path.last))
    # Nodes are numbers while they are searched.
    nodes = settle(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()))
    number = lambda c, to: nodes.select(F.col("node").alias(c), F.col("id").alias(to))
    coded = settle(edges.join(number("a", "x"), "a").join(number("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "step"))
    zero = begun.join(nodes, "node").select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("state"))
    opening = settle(_stepped(zero, coded, moves))
    named = lambda c: nodes.select(F.col("id").alias(c), F.col("node").alias(f"_{c}"))
    names = lambda pairs: pairs.join(named("node"), "node").join(named("start"), "start").select(F.col("_start").alias("start"), F.col("_node").alias("node"))
    if _one_way(coded, moves, opening):
        found = names(_walks(opening, coded, moves, most).filter(ended).select("start", "node").distinct())
        if own is not None:
            # Starts that are given reach themselves all; among all nodes, literals that a first step leaves backwards don't.
            found = found.filter("start <> node").union(own.distinct()) if starts is not None else found.union(own).distinct()
        return found if ends is None else found.join(ends.select("node"), "node", "left_semi").select("start", "node")
    # What is reached from a place that several starts come to is searched once for all of them.
    first, states = opening, len(path.steps) + 1
    mains = settle(_mains(first, states))
    shared = None
    if not mains.isEmpty():
        places = first.select(_place(states).alias("start"), "node", "state").join(mains.select(F.col("main").alias("start")), "start", "left_semi").distinct()
        shared = _search(places, coded, moves, most - 1).all()
        first = _others(first, mains, shared, ["node", "state"])
    alone = _search(first, coded, moves, most - 1, lambda step: step if shared is None else _others(step, mains, shared, ["node", "state"])).all()
    pairs = alone.filter(ended).select("start", "node")
    if own is not None:
        pairs = pairs.union(own.select("node").join(nodes, "node").select(F.col("id").alias("start"), F.col("id").alias("node")))
    pairs = pairs.distinct()
    found = None
    if shared is not None:
        # Each start has one main place, and this each node once: nothing is to be told apart among these pairs, which are most of all.
        whole = settle(shared.filter(ended).select("start", "node").distinct())
        pairs = _others(pairs, mains, whole, ["node"])
        met = settle(whole.withColumnRenamed("start", "main").join(named("node"), "node").select("main", F.col("_node").alias("node")))
        found = _product(settle(mains.join(named("start"), "start").select("main", F.col("_start").alias("start"))), met)
    found = names(pairs) if found is None else names(pairs).union(found)
    if own is not None:
        # Nodes that no step leaves or enters have no number.
        found = found.union(own.distinct().join(nodes, "node", "left_anti").select("start", "node"))
    return found if ends is None else found.join(ends.select("node"), "node", "left_semi").select("start", "node")
