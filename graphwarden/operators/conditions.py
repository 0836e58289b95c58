"""Conditions over the nodes of one table, as columns. Conditions of neighbours are evaluated once for
each node of the neighbours' tables and joined back along the path, never once for each pair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import column
from ..functions.nested import nested
from ..functions.tests import distinct_key, exactly_one, family, total, value_condition
from ..plans.ir import All, And, Bool, Closed, Count, Expr, Not, Or, Pair, Rel, Source, Test, Xone
from ..sources.graph import NodeTable, PropertyGraph
from .paths import Paths, union

ID = "__id"


@dataclass(frozen=True)
class Values:
    """The non-null values of one property: an array column and the neutral type of its elements."""

    array: Column
    kind: str


def property_values(t: NodeTable, names: tuple[str, ...], whole: bool = False) -> list[Values]:
    out = []
    for name in names:
        kind = t.properties.get(name)
        if kind is None:
            continue
        c = t.value(name)
        if kind.startswith("LIST<") and not whole:
            out.append(Values(F.filter(F.coalesce(c, F.array()), lambda v: v.isNotNull()), kind[5:-1]))
        elif kind == "ANY":
            inner = F.when(F.schema_of_variant(c).startswith("ARRAY<"), F.try_variant_get(c, "$", "array<variant>")).otherwise(F.array(c))
            out.append(Values(F.filter(inner, lambda v: v.isNotNull() & (F.schema_of_variant(v) != "VOID")), kind))
        else:
            out.append(Values(F.filter(F.array(c), lambda v: v.isNotNull()), kind))
    return out


def has_value(t: NodeTable, name: str) -> Column:
    """Whether a property has a value: empty lists, and lists of nulls, have none."""
    x = t.value(name)
    return total(F.exists(x, lambda v: v.isNotNull())) if t.properties[name].startswith("LIST<") else x.isNotNull()


def tester(test: Expr, kind: str, wanted: bool = True):
    """A function of one value for the higher-order functions."""
    return (lambda x: value_condition(test, x, kind)) if wanted else (lambda x: ~value_condition(test, x, kind))


def keyed(kind: str, cast: str | None):
    """A value as what is compared with others."""
    return (lambda x: distinct_key(x, kind).cast(cast)) if cast else (lambda x: distinct_key(x, kind))


def counted_up_to(rows: DataFrame, most: int, *what: str) -> DataFrame:
    """sid and n: how many different ``what`` (never null) each start has, ``most`` for so many and more. Only the
    first ``most`` of each start leave a task, and one exchange does: a rank limit works before and after it. Repeated
    rows of those travel along. Beyond the ranks that Spark limits early, plain distinct counts: they spread a hub's
    rows by what is counted."""
    if most > int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return rows.groupBy("sid").agg(F.count_distinct(*what).alias("n"))
    ranked = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("sid").orderBy(*what))).where(F.col("n") <= most)
    return ranked.groupBy("sid").agg(F.max("n").alias("n"))


class Conditions:
    def __init__(self, graph: PropertyGraph, node_key: str | None = None):
        self.graph, self.paths, self.node_key = graph, Paths(graph), node_key
        self.n = 0
        self.known: dict[tuple[Expr, str], DataFrame] = {}

    def fresh(self) -> str:
        self.n += 1
        return f"__{self.n}"

    def nodes(self, t: NodeTable) -> DataFrame:
        return t.df.withColumn(ID, column(t.key).cast(self.graph.key_type(t.label)))

    # -- conditions
    def on_nodes(self, e: Expr, t: NodeTable, df: DataFrame) -> tuple[DataFrame, Column]:
        """The frame, with what had to be joined to it, and the condition: true or false, never null."""
        if isinstance(e, Bool):
            return df, F.lit(e.value)
        if isinstance(e, Not):
            df, c = self.on_nodes(e.part, t, df)
            return df, ~c
        if isinstance(e, And | Or | Xone):
            parts = []
            for p in e.parts:
                df, c = self.on_nodes(p, t, df)
                parts.append(c)
            if isinstance(e, Xone):
                return df, exactly_one(parts)
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(e, And) else out | p
            return df, out
        if isinstance(e, Test):
            return df, self._node_test(e, t)
        if isinstance(e, All):
            return self._all(e, t, df)
        if isinstance(e, Count):
            return self._count(e, t, df)
        if isinstance(e, Pair):
            return self._pair(e, t, df)
        return self._closed(e, t, df)

    def _node_test(self, e: Test, t: NodeTable) -> Column:
        if e.kind == "label":
            if t.label in e.labels:
                return F.lit(True)
            return total(F.arrays_overlap(column(t.labels), F.array(*map(F.lit, e.labels)))) if t.labels else F.lit(False)
        if e.kind == "key":
            key = self.node_key if self.node_key in t.df.columns else t.key if self.node_key is None else None
            return total(column(key).cast("string").isin(*[c.value for c in e.values])) if key else F.lit(False)
        return F.lit(False)

    def _flag(self, df: DataFrame, starts: DataFrame) -> tuple[DataFrame, Column]:
        """Whether a node is among the starts (column sid, may repeat)."""
        name = self.fresh()
        marked = starts.select(F.col("sid").alias(f"{name}k")).distinct().withColumn(name, F.lit(True))
        return df.join(marked, F.col(ID) == F.col(f"{name}k"), "left").drop(f"{name}k"), F.col(name).isNotNull()

    def holding(self, e: Expr, t: NodeTable, wanted: bool) -> DataFrame:
        """Label and id of a table's nodes for which a condition is ``wanted``; the same condition of the
        same table is planned once."""
        key = (e if wanted else Not(e), t.label)
        if key not in self.known:
            df, c = self.on_nodes(e, t, self.nodes(t))
            self.known[key] = df.where(c if wanted else ~c).select(F.lit(t.label).alias("el"), F.col(ID).alias("eid"))
        return self.known[key]

    def failing(self, e: Expr, t: NodeTable, df: DataFrame) -> DataFrame:
        """The rows for which a condition fails. Where existence along a path decides, this is one semi or
        anti join: no distinct, no flag column."""
        if isinstance(e, All) and e.source.hops is not None:
            return self._with_start(df, self._failing_pairs(e, t), "left_semi")
        if isinstance(e, Count) and e.source.hops is not None and e.n == (1 if e.least else 0):
            return self._with_start(df, self._counted_pairs(e, t), "left_anti" if e.least else "left_semi")
        df, ok = self.on_nodes(e, t, df)
        return df.where(~ok)

    @staticmethod
    def _with_start(df: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
        return df.join(pairs.select("sid"), F.col(ID) == F.col("sid"), how)

    def _failing_pairs(self, e: All, t: NodeTable) -> DataFrame:
        pairs = self.paths.pairs(e.source.hops, t.label)
        if e.test != Bool(False) or not e.source.nodes:
            pairs = pairs.join(self._ends(e.source, e.test, t, False), ["el", "eid"], "left_semi")
        return pairs

    def _counted_pairs(self, e: Count, t: NodeTable) -> DataFrame:
        plain = e.filter == Bool(True) and e.source.nodes
        pairs = self.paths.pairs(e.source.hops, t.label, (e.n if e.least else e.n + 1) if plain else None)
        if not plain:
            pairs = pairs.join(self._ends(e.source, e.filter, t, True), ["el", "eid"], "left_semi")
        return pairs

    def end_tables(self, source: Source, t: NodeTable) -> list[NodeTable]:
        reached = self.paths.ends(source.hops, {t.label})
        return [x for x in self.graph.nodes if x.label in reached]

    def _ends(self, source: Source, test: Expr, t: NodeTable, wanted: bool) -> DataFrame:
        """Path ends with a value for which the test is ``wanted``."""
        found = []
        for end in self.end_tables(source, t):
            if source.nodes:
                found.append(self.holding(test, end, wanted))
                continue
            hit = F.lit(False)
            for v in property_values(end, source.properties, source.whole):
                hit = hit | F.exists(v.array, tester(test, v.kind, wanted))
            found.append(self.nodes(end).where(hit).select(F.lit(end.label).alias("el"), F.col(ID).alias("eid")))
        return union(found) if found else self.paths.empty({t.label}).select("el", "eid")

    def _all(self, e: All, t: NodeTable, df: DataFrame) -> tuple[DataFrame, Column]:
        if e.source.hops is None:
            out = F.lit(True)
            for v in property_values(t, e.source.properties, e.source.whole):
                out = out & F.forall(v.array, tester(e.test, v.kind))
            return df, total(out)
        df, failing = self._flag(df, self._failing_pairs(e, t))
        return df, ~failing

    def _count(self, e: Count, t: NodeTable, df: DataFrame) -> tuple[DataFrame, Column]:
        if e.source.hops is None:
            n = self._count_values(property_values(t, e.source.properties, e.source.whole), e.filter)
            return df, (n >= e.n) if e.least else (n <= e.n)
        exists = e.n == (1 if e.least else 0)
        if e.source.nodes or exists:
            pairs = self._counted_pairs(e, t)
            if exists:
                df, some = self._flag(df, pairs)
                return df, some if e.least else ~some
            counted = self._ends_counted(pairs, t, e)
        else:
            rows = self._value_rows(e.source, t, e.filter)
            counted = self.paths.pairs(e.source.hops, t.label).join(rows, ["el", "eid"])
            counted = counted_up_to(counted, e.n if e.least else e.n + 1, "family", "v")
        name = self.fresh()
        counted = counted.select(F.col("sid").alias(f"{name}k"), F.col("n").alias(name))
        n = F.coalesce(F.col(name), F.lit(0))
        return df.join(counted, F.col(ID) == F.col(f"{name}k"), "left").drop(f"{name}k"), (n >= e.n) if e.least else (n <= e.n)

    def _ends_counted(self, pairs: DataFrame, t: NodeTable, e: Count) -> DataFrame:
        """sid and n, the number of different ends, as far as the bound asks for it. Where only one or two matter, the
        least and the greatest tell: one row of each start leaves a task, however many relationships a hub has."""
        wanted = e.n if e.least else e.n + 1
        if wanted == 2:
            end = F.struct("el", "eid") if len(self.paths.ends(e.source.hops, {t.label})) > 1 else F.col("eid")
            return pairs.groupBy("sid").agg((F.min(end) != F.max(end)).cast("int").alias("n")).withColumn("n", F.col("n") + 1)
        return counted_up_to(pairs, wanted, "el", "eid")

    def _value_rows(self, source: Source, t: NodeTable, test: Expr) -> DataFrame:
        """el, eid, family, v (text) of the values at path ends that satisfy a test."""
        found = []
        for end in self.end_tables(source, t):
            for v in property_values(end, source.properties, source.whole):
                text = F.transform(F.filter(v.array, tester(test, v.kind)), keyed(v.kind, "string"))
                found.append(self.nodes(end).select(F.lit(end.label).alias("el"), F.col(ID).alias("eid"), F.lit(family(v.kind)).alias("family"), F.explode(text).alias("v")))
        return union(found) if found else self.graph.spark.createDataFrame([], f"el string, eid {self.graph.key_type(t.label)}, family string, v string")

    @staticmethod
    def _count_values(values: list[Values], test: Expr) -> Column:
        """Number of distinct values of several properties; only values of one family can be equal."""
        groups: dict[str, list[Column]] = {}
        for v in values:
            kept = F.filter(v.array, tester(test, v.kind)) if test != Bool(True) else v.array
            groups.setdefault(family(v.kind), []).append(F.transform(kept, keyed(v.kind, {"INT": "bigint", "FLOAT": "double"}.get(family(v.kind)))))
        n = F.lit(0)
        for arrays in groups.values():
            n = n + F.size(F.array_distinct(F.concat(*arrays) if len(arrays) > 1 else arrays[0]))
        return n

    # -- pairs of value sets
    def _pair(self, e: Pair, t: NodeTable, df: DataFrame) -> tuple[DataFrame, Column]:
        if not e.left.nodes and not e.right.nodes:
            return df, total(self._pair_values(e, t))
        if e.left.nodes != e.right.nodes:
            df, left = self._count(Count(e.left, Bool(True), True, 1), t, df)
            df, right = self._count(Count(e.right, Bool(True), True, 1), t, df)
            return df, (~left & ~right) if e.op == "equals" else F.lit(True) if e.op == "disjoint" else ~(left & right)
        sides = [self.paths.pairs(s.hops, t.label).distinct() if s.hops is not None else self.paths._nodes({t.label}) for s in (e.left, e.right)]
        on = ["sl", "sid", "el", "eid"]
        if e.op == "equals":
            # one pass over both sides: a pair must stand on each
            tagged = sides[0].withColumn("side", F.lit(1)).unionAll(sides[1].withColumn("side", F.lit(2)))
            failing = tagged.groupBy(*on).agg(F.sum("side").alias("s")).where("s <> 3")
        elif e.op == "disjoint":
            failing = sides[0].join(sides[1], on, "left_semi")
        else:  # nodes have no order: fails where both sides have any
            failing = sides[0].select("sl", "sid").join(sides[1].select("sl", "sid"), ["sl", "sid"], "left_semi")
        df, bad = self._flag(df, failing)
        return df, ~bad

    @staticmethod
    def _pair_values(e: Pair, t: NodeTable) -> Column:
        left, right = (property_values(t, s.properties, s.whole) for s in (e.left, e.right))
        numeric = ("INT", "FLOAT")

        def merged(values: list[Values], to: str | None) -> dict[str, Column]:
            out: dict[str, Column] = {}
            for v in values:
                f = family(v.kind)
                key = "NUMBER" if f in numeric else f
                a = F.transform(v.array, keyed(v.kind, to if f in numeric else None))
                out[key] = F.concat(out[key], a) if key in out else a
            return out

        kinds = {family(v.kind) for v in [*left, *right]} & set(numeric)
        to = "double" if "FLOAT" in kinds else "bigint"
        a, b = merged(left, to), merged(right, to)
        if e.op == "equals":
            out = F.lit(True)
            for k in {**a, **b}:
                if k in a and k in b:
                    out = out & (F.size(F.array_except(a[k], b[k])) == 0) & (F.size(F.array_except(b[k], a[k])) == 0)
                else:
                    out = out & (F.size(a.get(k, b.get(k))) == 0)
            return out
        if e.op == "disjoint":
            out = F.lit(True)
            for k in a.keys() & b.keys():
                out = out & ~F.coalesce(F.arrays_overlap(a[k], b[k]), F.lit(False))
            return out
        out = F.lit(True)
        for k, x in a.items():
            for m, y in b.items():
                if k == m and k not in ("ANY", "BLOB") and not nested(k) and not k.startswith("LIST<"):
                    # every value on the left against the least on the right
                    top, low = F.array_max(x), F.array_min(y)
                    out = out & F.coalesce(top < low if e.op == "lessThan" else top <= low, F.lit(True))
                    if k == "NUMBER" and to == "double":
                        out = out & ((F.size(x) == 0) | (F.size(y) == 0) | ~F.exists(F.concat(x, y), F.isnan))
                else:
                    out = out & ((F.size(x) == 0) | (F.size(y) == 0))
        return out

    def _closed(self, e: Closed, t: NodeTable, df: DataFrame) -> tuple[DataFrame, Column]:
        out = F.lit(True)
        for name in t.df.columns:  # a column counts as named if one of its fields is; no predicate is called @
            if name in t.properties and name != t.key and not name.startswith("@") and not any(p == name or p.startswith(f"{name}.") for p in e.properties):
                out = out & ~has_value(t, name)
        types = tuple(sorted({r.type for r in self.graph.rels if r.start == t.label and r.type not in e.rels}))
        if types:
            df, extra = self._flag(df, self.paths.edges(Rel(types), {t.label}))
            out = out & ~extra
        return df, out
