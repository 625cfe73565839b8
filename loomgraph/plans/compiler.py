"""Compiles mapping rules into DataFrame plans."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import TRIPLE, identity
from ..sources.rules import RR, Call, ObjectMap, Rule, UnsupportedRule, Value
from ..sources.shared import exists, file_size, is_file
from ..sources.tables import MissingSource, header, read_csv
from .fields import Table, fields, shape

#: Files that a task keeps open while it writes a graph by predicate.
WRITERS, OPEN = "spark.sql.maxConcurrentOutputFileWriters", 16


def quads(rules: list[Rule]) -> bool:
    """Whether rules name graphs."""
    return any(r.graphs or any(o.graphs for o in r.objects) for r in rules)


def _kind(graphs: bool) -> str:
    return f"array<struct<{TRIPLE.replace(' string', ':string')}{', g:string' if graphs else ''}>>"


def _in_graphs(s: Column, named: tuple[Value, ...], row: Table) -> list[tuple[Column, Column]]:
    """Subject and graph for each graph that is named; where a graph's name is missing, the subject is null and no quad is made."""
    if not named:
        return [(s, F.lit(None).cast("string"))]
    texts = [(v, F.lit(None).cast("string") if v.constant == RR + "defaultGraph" else row.text(v)) for v in named]
    return [(s if v.constant is not None else F.when(g.isNotNull(), s), g) for v, g in texts]


def _triple(rule: Rule, o: ObjectMap, s: Column, value: Column, g: Column | None) -> Column:
    parts = [s.alias("s"), F.lit(o.predicate).alias("p"), value.alias("o"), F.lit("iri" if o.iri else "literal").alias("o_kind"), F.lit(None if o.iri else o.datatype).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"), F.lit(rule.name).alias("src")]
    return F.struct(*parts, *([g.alias("g")] if g is not None else []))


Maker = Callable[[Rule, ObjectMap, Column, Column, Column | None], Column]


def _made(rule: Rule, row: Table, graphs: bool, known: dict[str, Rule], make: Maker = _triple) -> tuple[list[Column], list[Column]]:
    """The triples of one rule at one place: single ones, and arrays of those that a list gives. Objects that need a join aren't among them."""
    single, lists = [], []
    s = row.text(rule.about)
    for o in rule.objects:
        value = o.value if o.parent is None else own_parent(rule, o, known)
        if value is None:
            continue
        for subject, g in _in_graphs(s, (*rule.graphs, *o.graphs), row):
            named = g if graphs else None
            if row.several(value):
                lists.append(F.transform(row.all(value), lambda x: make(rule, o, subject, x, named)))  # noqa: B023  called at once
            else:
                single.append(make(rule, o, subject, row.text(value), named))
    return single, lists


def _together(single: list[Column], lists: list[Column], kind: str) -> Column:
    parts = ([F.array(*single)] if single else []) + lists
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.array().cast(kind)


def triples_of(rules: list[Rule], schema: T.StructType, known: dict[str, Rule] | None = None, graphs: bool | None = None, make: Maker = _triple, kind: str | None = None) -> Column:
    """All triples that the rules make of a row, as one array of type ``kind``. ``known`` has the rules that objects name as parents."""
    known = known or {r.name: r for r in rules}
    graphs = quads(rules) if graphs is None else graphs
    kind = kind or _kind(graphs)
    single, lists = [], []
    for r in rules:
        if r.formulation == "json":
            lists.append(fields(r, schema).over(lambda row, r=r: _together(*_made(r, row, graphs, known, make), kind), kind))
        else:
            more = _made(r, fields(r, schema), graphs, known, make)
            single, lists = single + more[0], lists + more[1]
    return _together(single, lists, kind)


def generate(table: DataFrame, rules: list[Rule], known: dict[str, Rule] | None = None, graphs: bool | None = None) -> DataFrame:
    """All triples of the rules over one table, from one scan: each row's array is inlined.

    Objects that are null give no triple; neither do subjects. With named graphs there is a column ``g``.
    """
    # Arrays are made by a projection, whose code is cut into methods that the JVM compiles, and then taken apart.
    rows = table.select(triples_of(rules, table.schema, known, graphs).alias("made")).select(F.inline_outer("made"))
    return rows.filter(F.col("s").isNotNull() & F.col("o").isNotNull())


# Set semantics of rows' triples, before these are written out.


class Coded:
    """Triples by number: what rules fix of them (predicate, kind, datatype, source) is one number, and only subjects and objects are text.

    A graph is made by one shuffle of rows by subject, each with all its triples of that subject: a tenth of what the triples take, and
    no task gathers them before. Rows that are equal in all that rules read meet once beforehand, so that a table that says a thing many
    times is no hot key. Nested documents, whose parts overlap, are taken apart first.
    """

    def __init__(self, rules: list[Rule], known: dict[str, Rule], graphs: bool):
        self.known, self.graphs, self.nested = known, graphs, any(r.formulation == "json" for r in rules)
        self.sources = sorted({r.name for r in rules})
        fixed = [(o.predicate, "iri" if o.iri else "literal", None if o.iri else o.datatype, r.name) for r in rules for o in r.objects]
        self.codes = {x: i for i, x in enumerate(dict.fromkeys(fixed))}
        self.kinds = list(dict.fromkeys(x[:3] for x in self.codes))
        self.own = ["o", *(["g"] if graphs else [])]
        self.type = f"struct<c:int,{','.join(f'{c}:string' for c in self.own)}>"

    def _one(self, rule: Rule, o: ObjectMap, s: Column, value: Column, g: Column | None) -> Column:
        code = self.codes[o.predicate, "iri" if o.iri else "literal", None if o.iri else o.datatype, rule.name]
        # The subject is null as well where a graph has no name.
        shown = value if g is None else F.when(s.isNotNull(), value)
        return F.struct(*([s.alias("s")] if self.nested else []), F.lit(code).alias("c"), shown.alias("o"), *([g.alias("g")] if g is not None else []))

    def codes_of(self, predicate: str) -> list[int] | None:
        """The numbers of a predicate's triples, whose objects alone tell these apart; None where kinds or graphs do as well."""
        own = {x: i for x, i in self.codes.items() if x[0] == predicate}
        return None if self.graphs or len({x[:3] for x in own}) > 1 else list(own.values())

    def rows(self, table: DataFrame, rules: list[Rule]) -> DataFrame:
        """``s, made`` of a flat table: a row for each subject that a row names, with its triples. Of nested documents ``s, c, o``."""
        if self.nested:
            return table.select(F.inline(triples_of(rules, table.schema, self.known, self.graphs, self._one, f"array<{self.type.replace('<', '<s:string,')}>")))
        table, by = _once(table, rules, self.known), defaultdict(list)
        for r in rules:
            by[r.about].append(r)
        parts = [[fields(own[0], table.schema).text(about).alias("s"), triples_of(own, table.schema, self.known, self.graphs, self._one, f"array<{self.type}>").alias("made")] for about, own in by.items()]
        made = table.select(*parts[0]) if len(parts) == 1 else table.select(F.array(*[F.struct(*x) for x in parts]).alias("x")).select(F.inline_outer("x"))
        return made.filter(F.col("s").isNotNull())

    def graph(self, parts: list[DataFrame]) -> DataFrame:
        """The triples, each once, with the first by name of the rules that state it."""
        whole = reduce(DataFrame.union, parts)
        if self.nested and (n := partitions(whole)) > int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            # Of large documents, triples are dealt out as they are: to gather them first would take the shuffle's own number of parts.
            whole = whole.repartition(n, "s")
        elif not self.nested:
            # Empty arrays give a row without an object, which goes below; else Spark would look at each array's size, and make it for that, in the scan.
            whole = Rows(self, parts).shuffled().select("s", F.inline_outer("made"))
        of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("c") + 1)
        coded = whole.filter(F.col("s").isNotNull() & F.col("o").isNotNull()).select("s", of([self.kinds.index(x[:3]) for x in self.codes]).alias("k"), *self.own, of([self.sources.index(x[3]) for x in self.codes]).alias("r"))
        once = coded.groupBy("s", "k", *self.own).agg(F.min("r").alias("r"))
        name = lambda i: F.element_at(F.array(*[F.lit(x[i]).cast("string") for x in self.kinds]), F.col("k") + 1)
        columns = {"p": name(0), "o_kind": name(1), "o_datatype": name(2), "o_lang": F.lit(None).cast("string"), "src": F.element_at(F.array(*[F.lit(n) for n in self.sources]), F.col("r") + 1)}
        return once.select(*[columns[c].alias(c) if c in columns else c for c in [*identity(self.own), "src"]])


#: Bytes of files whose triples a task may gather, of columns packed together and of text; and the most partitions to be asked for.
PACKED, PLAIN, MOST = 4 << 20, 8 << 20, 1 << 16


def partitions(df: DataFrame) -> int:
    """How many parts a graph made of ``df`` is gathered in: as many as the session has for shuffles, and more where the files read are
    larger, so that a task's share doesn't grow with the input."""
    spark, paths = df.sparkSession, df.inputFiles()
    # Of very many files some tell how large they are: this is a number of parts, and all are read.
    some = paths[:: max(1, len(paths) // 1000)]
    size = sum(file_size(spark, path) / (PACKED if path.endswith((".parquet", ".orc")) else PLAIN) for path in some)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST, math.ceil(size * len(paths) / max(1, len(some)))))


@dataclass
class Rows:
    """Rows of flat tables with their triples by subject."""

    coded: Coded
    parts: list[DataFrame]

    def shuffled(self) -> DataFrame:
        """``s, made`` by subject."""
        whole = reduce(DataFrame.union, self.parts)
        # The number is given, so that adaptive execution, which sees packed rows, doesn't put parts together whose triples are many times as large.
        return whole.repartition(partitions(whole), "s")


def _once(table: DataFrame, rules: list[Rule], known: dict[str, Rule]) -> DataFrame:
    """What rules read of a table, equal rows once. Negative zeros, which grouping takes for zeros, stay apart by a column of their own."""
    read = [c for r in rules for c in r.columns()] + [c for r in rules for o in r.objects if o.parent is not None for c in known[o.parent].columns()]
    names = [c for c in dict.fromkeys(read) if c in table.columns]
    kinds = {c: table.schema[c].dataType for c in names}
    if not names or any(isinstance(k, (T.MapType, T.VariantType, T.ArrayType, T.StructType)) for k in kinds.values()):
        return table
    real = {c: f"{c}_below" for c, k in kinds.items() if isinstance(k, (T.DoubleType, T.FloatType))}
    below = [((F.col(f"`{c}`") == 0) & (F.col(f"`{c}`").cast("string") == "-0.0")).alias(b) for c, b in real.items()]
    once = table.select(*[F.col(f"`{c}`") for c in names], *below).distinct()
    return once.select(*[F.when(F.col(f"`{real[c]}`"), F.lit(-0.0).cast(kinds[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in real else F.col(f"`{c}`") for c in names])


# Objects that are other rules' subjects.


def _renamed(value: Value, names: dict[str, str]) -> Value:
    """A value that reads other columns in place of its own."""
    fill = lambda t: re.sub(r"(?<!\\)\{([^{}]*)\}", lambda m: "{" + names[m[1]] + "}", t)
    call = value.call and Call(value.call.function, tuple((p, _renamed(v, names)) for p, v in value.call.arguments))
    return Value(value.template and fill(value.template), value.constant, value.reference and names[value.reference], call)


def own_parent(rule: Rule, o: ObjectMap, known: dict[str, Rule]) -> Value | None:
    """What stands for a parent's subject in the row itself, if no join is needed: null if one is.

    That is so where both rules read the same rows, and either no condition is given, or each compares a column with
    itself and the parent's subject has no other columns: every row that joins has the same subject, and the row is one of them.
    """
    parent = known[o.parent]
    if (rule.source, rule.formulation, rule.iterator) != (parent.source, parent.formulation, parent.iterator):
        if not o.joins:
            raise UnsupportedRule(f"{rule.name}: a parent of other rows needs join conditions")
        return None
    same = all(child == column for child, column in o.joins) and set(parent.about.references()) <= {column for _, column in o.joins}
    return parent.about if same or not o.joins else None


def needs_join(rule: Rule, known: dict[str, Rule]) -> list[ObjectMap]:
    return [o for o in rule.objects if o.parent is not None and own_parent(rule, o, known) is None]


def _rows(table: DataFrame, rule: Rule, wanted: dict[str, Callable[[Table], Column]]) -> DataFrame:
    """Columns for each part that a rule iterates over; for a flat table, of its rows, with their types."""
    if rule.formulation != "json":
        row = fields(rule, table.schema)
        return table.select(*[f(row).alias(name) for name, f in wanted.items()])
    kind = f"array<struct<{', '.join(f'{name}:string' for name in wanted)}>>"
    return table.select(F.inline(fields(rule, table.schema).over(lambda row: F.array(F.struct(*[f(row).alias(name) for name, f in wanted.items()])), kind)))


def join_triples(rule: Rule, o: ObjectMap, child: DataFrame, parent_rule: Rule, parent: DataFrame, graphs: bool = False) -> DataFrame:
    """Triples of an object that is the subject of the parent's rows whose columns equal the child's.

    Where the conditions fix all columns of the parent's subject, a row has one such object at most: whether there is a parent
    is all that the join asks (a semi join), and the object is made of the child's own columns. Otherwise the parent's subjects are
    joined, each once a key. Values of different types are compared as text; nulls join nothing.
    """
    named = (*rule.graphs, *o.graphs)
    native = lambda t, r, c: r.formulation != "json" and isinstance(t.schema[c].dataType, (T.IntegralType, T.DateType, T.StringType)) and t.schema[c].dataType
    same = [bool(native(child, rule, a)) and native(child, rule, a) == native(parent, parent_rule, b) for a, b in o.joins]
    key = lambda c, plain: (lambda row: F.col(f"`{c}`") if plain else row.text(Value(reference=c)))
    fixed = dict((b, a) for a, b in o.joins)
    semi = set(parent_rule.about.references()) <= set(fixed)
    left = {"s": lambda row: row.text(rule.about), **{f"k{i}": key(a, same[i]) for i, (a, _) in enumerate(o.joins)}}
    left |= {f"g{i}": (lambda row, v=v: row.text(v)) for i, v in enumerate(named)}
    right = {f"k{i}": key(b, same[i]) for i, (_, b) in enumerate(o.joins)}
    if semi:
        left["o"] = lambda row: row.text(_renamed(parent_rule.about, fixed))
    else:
        right["o"] = lambda row: row.text(parent_rule.about)
    on = [f"k{i}" for i in range(len(o.joins))]
    rows, others = _rows(child, rule, left), _rows(parent, parent_rule, right)
    found = rows.join(others, on, "left_semi") if semi else rows.join(others.distinct(), on)
    made = []
    for i, v in enumerate(named or [None]):
        default = v is None or v.constant == RR + "defaultGraph"
        g = F.lit(None).cast("string") if default else F.col(f"g{i}")
        s = F.col("s") if default else F.when(g.isNotNull(), F.col("s"))
        made.append(_triple(rule, o, s, F.col("o"), g if graphs else None))
    return found.select(F.inline(F.array(*made))).filter(F.col("s").isNotNull() & F.col("o").isNotNull())


def prune(rules: list[Rule], predicates: set[str] | None = None, iris: bool = False) -> list[Rule]:
    """The parts of rules that a query can use: objects of some predicates, or objects that are IRIs.

    Triples come from arrays, which no filter reaches into; pruning rules first keeps other triples from being made, and
    their columns from being read. Rules that others name as parents stay, without objects.
    """
    kept = [replace(r, objects=tuple(o for o in r.objects if (predicates is None or o.predicate in predicates) and (o.iri or not iris))) for r in rules]
    parents = {o.parent for r in kept for o in r.objects}
    return [r for r in kept if r.objects or r.name in parents]


def is_relation(rule: Rule) -> bool:
    """A table of two columns that states one IRI of each subject."""
    if not rule.plain():
        return False
    single = len(rule.objects) == 1 and rule.objects[0].iri and rule.objects[0].constant is None
    ends = rule.subject.endswith("}") and rule.subject.count("{") == 1
    return single and ends and (rule.objects[0].template is None or (rule.objects[0].template.endswith("}") and rule.objects[0].template.count("{") == 1)) and len(rule.columns()) == 2


def fuse_relations(spark: SparkSession, base: str, rules: list[Rule]) -> DataFrame:
    """All relation tables by one scan of many files, told apart by file name.

    The catalogue of file names has one row a rule and is broadcast; rules come from a mapping that the driver holds.
    """
    cut = lambda t: t[: t.index("{")] if t else ""
    rows = [(r.source.rpartition("/")[2], r.name, cut(r.subject), r.objects[0].predicate, cut(r.objects[0].template), r.objects[0].template is not None) for r in rules]
    catalogue = spark.createDataFrame(rows, "file string, src string, s_head string, p string, o_head string, encoded boolean")
    from ..functions.terms import iri_safe

    scan = read_csv(spark, [f"{base}/{r.source}" for r in rules], ["s", "o"]).select("s", "o", F.col("_metadata.file_name").alias("file"))
    joined = scan.filter(F.col("s").isNotNull() & F.col("o").isNotNull()).join(F.broadcast(catalogue), "file")
    none = F.lit(None).cast("string")
    return joined.select(F.concat("s_head", iri_safe(F.col("s"))).alias("s"), "p", F.when(F.col("encoded"), F.concat("o_head", iri_safe(F.col("o")))).otherwise(F.col("o")).alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"), "src")


@dataclass
class Build:
    """Triples as a bag, and the sources that weren't there."""

    triples: DataFrame
    missing: list[str] = field(default_factory=list)
    once: DataFrame | None = None
    rows: Rows | None = None

    def graph(self) -> DataFrame:
        """The graph: each triple once, whichever rules state it. One shuffle for all rules together, of rows where no rule joins others'."""
        return dedupe(self.triples) if self.once is None else self.once


def dedupe(triples: DataFrame) -> DataFrame:
    """Set semantics over a triple's identity; of several rules that state it, the first by name stays as its source."""
    return triples.groupBy(*identity(triples.columns)).agg(F.min("src").alias("src"))


def _union(parts: list[DataFrame], graphs: bool) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=graphs), parts)


def _joins(rules: list[Rule], known: dict[str, Rule], table_of: Callable[[str], DataFrame], graphs: bool) -> list[DataFrame]:
    return [join_triples(r, o, table_of(r.source), known[o.parent], table_of(known[o.parent].source), graphs) for r in rules for o in needs_join(r, known)]


def _parents(rules: list[Rule], known: dict[str, Rule]) -> list[tuple[Rule, str]]:
    """The columns that conditions read of parents."""
    return [(known[o.parent], b) for r in rules for o in r.objects if o.parent is not None for _, b in o.joins]


def _coded(rules: list[Rule], known: dict[str, Rule], table_of: Callable[[str], DataFrame], graphs: bool) -> tuple[DataFrame | None, Rows | None]:
    """The graph of rules by number, if none needs a join, and the rows that it is made of, if tables are flat."""
    by = defaultdict(list)
    for r in rules:
        if r.objects:
            by[r.source].append(r)
    if not by or any(needs_join(r, known) for r in rules):
        return None, None
    coded = Coded([r for own in by.values() for r in own], known, graphs)
    parts = [coded.rows(table_of(source), own) for source, own in by.items()]
    return coded.graph(parts), None if coded.nested else Rows(coded, parts)


def build_csv(spark: SparkSession, rules: list[Rule], base: str, strict: bool = False) -> Build:
    """Run rules over files below ``base``: CSV tables, and JSON documents (one a line, or a file each below a folder named ``*.docs``).

    Missing files raise if ``strict``, else they are listed in the result. Each source is read by one scan for all its rules;
    objects of other rows' subjects are joined beside.
    """
    known, graphs = {r.name: r for r in rules}, quads(rules)
    sources = {r.source: r.formulation for r in rules}
    there = {s: exists(spark, f"{base}/{s}") for s in sources}
    missing = sorted(s for s, ok in there.items() if not ok)
    if missing and strict:
        raise MissingSource(", ".join(missing))
    present = [r for r in rules if there[r.source] and all(there[known[o.parent].source] for o in r.objects if o.parent)]
    lost = [r for r in rules if there[r.source] and r not in present]
    present += [replace(r, objects=tuple(o for o in r.objects if not o.parent or there[known[o.parent].source])) for r in lost]
    names = defaultdict(list)
    for r in present:
        names[r.source].append(r)

    def table_of(source: str) -> DataFrame:
        own = [r for r in present if r.source == source]
        if sources[source] == "json":
            read = spark.read.schema(shape(own, [x for x in _parents(present, known) if x[0].source == source]))
            return read.option("mode", "FAILFAST").option("multiLine", source.endswith(".docs")).json(f"{base}/{source}")
        return read_csv(spark, f"{base}/{source}", header(spark, f"{base}/{source}"))

    # A relation is fused if it is one file, of a unique name, no other rule reads it, and its columns are subject, then object.
    last = defaultdict(int)
    for s in names:
        last[s.rpartition("/")[2]] += 1
    fused = [r for r in present if is_relation(r) and len(names[r.source]) == 1 and last[r.source.rpartition("/")[2]] == 1 and is_file(spark, f"{base}/{r.source}") and r.columns() == header(spark, f"{base}/{r.source}")]
    parts = [fuse_relations(spark, base, fused)] if fused else []
    done = {r.name for r in fused}
    for source, own in names.items():
        own = [r for r in own if r.name not in done and r.objects]
        if own:
            parts.append(generate(table_of(source), own, known, graphs))
    parts += _joins(present, known, table_of, graphs)
    if not parts:
        return Build(spark.createDataFrame([], TRIPLE), missing)
    return Build(_union(parts, graphs), missing, *((None, None) if fused else _coded(present, known, table_of, graphs)))


def build_tables(rules: list[Rule], tables: dict[str, DataFrame]) -> Build:
    """Run rules over DataFrames by name: one scan a table, and joins of tables for objects of other rows' subjects.

    Rules of nested documents read columns as the documents' top (``fields.parsed`` makes such a table of JSON text).
    """
    known, graphs = {r.name: r for r in rules}, quads(rules)
    by = defaultdict(list)
    for r in rules:
        by[r.source].append(r)
    there = [replace(r, objects=tuple(o for o in r.objects if not o.parent or known[o.parent].source in tables)) for r in rules if r.source in tables]
    parts = [generate(tables[s], [r for r in there if r.source == s], known, graphs) for s in by if s in tables and any(r.objects for r in by[s])]
    parts += _joins(there, known, tables.__getitem__, graphs)
    if not parts:
        raise MissingSource(", ".join(sorted(by)) or "no rules")
    return Build(_union(parts, graphs), sorted(s for s in by if s not in tables), *_coded(there, known, tables.__getitem__, graphs))


def store(triples: DataFrame, path: str) -> None:
    """Keep a graph as Parquet by predicate, so that a pattern with a predicate reads its folder alone. Rebalancing cuts hot predicates.

    A task then has few predicates: it keeps their files open side by side, and sorts its rows by predicate only where they are more than OPEN.
    """
    conf = triples.sparkSession.conf
    before = conf.get(WRITERS)
    conf.set(WRITERS, str(OPEN))
    try:
        triples.hint("rebalance", "p").write.mode("overwrite").partitionBy("p").parquet(path)
    finally:
        conf.set(WRITERS, before)
