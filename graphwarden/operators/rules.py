"""Violations of rules as DataFrames.

Columns: rule_id, rule_name, shape, path, constraint, severity, focus_label (of a node with several labels
the first that is targeted), focus_key, focus_id, focus_start and focus_end (the endpoints' keys of a
relationship), value, value_label and value_key (if the value is a node), message, details, properties (JSON of
the focus, if verbose). Rules over the same label that need no joins are fused: one scan tests them all; rules over the nodes at
the end of one path share the path."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from ..functions import nested
from ..functions.names import column
from ..functions.tests import shown, value_condition
from ..plans.ir import Bool, Count, Focus, Rel, Rule, Source, Step, closed_in, sources_of
from ..sources.graph import NodeTable, PropertyGraph
from .conditions import ID, Conditions, counted_up_to, has_value, property_values, tester
from .paths import union

KEY, LABEL, START, END, PROPERTIES = "__key", "__label", "__start", "__end", "__properties"
CARRIED = [ID, KEY, LABEL, START, END, PROPERTIES]
COLUMNS = ["rule_id", "rule_name", "shape", "path", "constraint", "severity", "focus_label", "focus_key", "focus_id", "focus_start", "focus_end", "value", "value_label", "value_key", "message", "details", "properties"]
#: Equal relationships made anew at a time.
BLOCK = 1 << 16
SCHEMA = ", ".join(f"{c} {'array<string>' if c == 'details' else 'string'}" for c in COLUMNS)


def _numbered(k: int):
    return lambda x: F.struct(F.lit(k).alias("k"), x["value"].alias("value"), x["details"].alias("details"))


def _nothing() -> Column:
    return F.lit(None).cast("string")


def first_of_each(rows: DataFrame, n: int) -> DataFrame:
    """The first n violations of each rule; each task hands on n rows of a rule at most."""
    order = Window.partitionBy("rule_id").orderBy("focus_label", "focus_key", "focus_id", "value")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


@dataclass
class FocusTable:
    """Focus nodes (or relationships) of one table: a frame with the columns __id and __key."""

    table: NodeTable
    df: DataFrame
    #: Whether rows of the same id may be different relationships.
    equal_rows: bool = False


def joins_needed(rule: Rule) -> bool:
    """Whether a rule leaves its focus table."""
    exprs = [rule.holds, *(d.holds for d in rule.details)]
    hops = [s for e in exprs for s in sources_of(e)] + ([rule.source] if rule.source else [])
    return any(s.hops is not None for s in hops) or any(closed_in(e) for e in exprs)


def way(rule: Rule) -> Step | None:
    """The path of a rule that only asks for the nodes at its end: counts of them, or a condition of each."""
    if rule.source is not None:
        return rule.source.hops if rule.source.nodes else None
    e = rule.holds
    return e.source.hops if isinstance(e, Count) and e.source.nodes and not rule.details else None


class Engine:
    """``only``: violations of this node table alone (the others still serve as what paths lead to)."""

    def __init__(self, graph: PropertyGraph, node_key: str | None = None, verbose: bool = False, only: str | None = None):
        self.graph, self.node_key, self.verbose, self.only = graph, node_key, verbose, only
        self.conditions = Conditions(graph, node_key)

    def clear(self) -> None:
        """Delete what repeated paths have written, once none of this engine's frames is needed."""
        self.conditions.paths.clear()

    # -- focus
    def focus(self, rule: Rule) -> list[FocusTable]:
        if any(f.kind == "relationships" for f in rule.focus):
            types = {x for f in rule.focus for x in f.types}
            return [self._edges(r, rule) for r in self.graph.rels if r.type in types]
        out = []
        for t in self.graph.nodes:
            df = self._members(t, rule.focus) if self.only in (None, t.label) else None
            if df is not None:
                out.append(FocusTable(t, df.withColumns({KEY: self._key(t, rule.key), LABEL: self._label(t, rule), START: _nothing(), END: _nothing(), PROPERTIES: self._properties(t)})))
        return out

    @staticmethod
    def _label(t: NodeTable, rule: Rule) -> Column:
        wanted = [x for f in rule.focus if f.kind == "labels" for x in f.labels]
        if not t.labels or not wanted:
            return F.lit(t.label)
        carried = [F.when(F.lit(x == t.label) | F.coalesce(F.array_contains(column(t.labels), x), F.lit(False)), F.lit(x)) for x in wanted]
        return F.coalesce(*carried, F.lit(t.label))

    def _properties(self, t: NodeTable) -> Column:
        if not self.verbose:
            return F.lit(None).cast("string")
        return F.to_json(F.struct(*(column(c) for c in t.df.columns if c != ID)))

    def _key(self, t: NodeTable, own: str | None = None) -> Column:
        for c in (own, self.node_key):
            if c and c in t.df.columns:
                return column(c).cast("string")
        return F.col(ID).cast("string")

    def _edges(self, r, rule: Rule) -> FocusTable:
        """Relationships are told apart by their key column; without one, parallel ones by a hash of their properties,
        and equal ones by a number (``_told_apart``)."""
        start, end = column(r.src).cast("string"), column(r.dst).cast("string")
        ends = F.concat_ws("->", start, end)
        others = [nested.flat(column(f.name), f.dataType) for f in r.df.schema.fields if f.name not in (r.src, r.dst)]
        others = [F.to_json(F.struct(c)) if isinstance(f.dataType, VariantType) else c for c, f in zip(others, (f for f in r.df.schema.fields if f.name not in (r.src, r.dst)))]
        own = column(r.key).cast("string") if r.key else F.concat(ends, F.lit("#"), F.hex(F.xxhash64(*others))) if others else ends
        df = r.df.withColumns({ID: own, KEY: ends, START: start, END: end, LABEL: F.lit(r.type)})
        table = NodeTable(r.type, df.drop(r.src, r.dst, KEY, START, END, LABEL), ID)
        return FocusTable(table, df.withColumn(PROPERTIES, self._properties(table)), r.key is None)

    def _members(self, t: NodeTable, focus: tuple[Focus, ...]) -> DataFrame | None:
        """A table's focus nodes, each once; None if it can't have any."""
        df = self.conditions.nodes(t)
        labels = [x for f in focus if f.kind == "labels" for x in f.labels]
        if t.label in labels:
            return df
        parts: list[Column] = []
        if t.labels and labels:
            parts.append(F.coalesce(F.arrays_overlap(column(t.labels), F.array(*map(F.lit, labels))), F.lit(False)))
        for f in focus:
            if f.kind == "subjects" and f.source.hops is None:
                found = [has_value(t, p) for p in f.source.properties if p in t.properties]
                parts += found
            elif f.kind in ("subjects", "objects"):
                hop = f.source.hops
                hop = hop if f.kind == "subjects" else Rel(hop.types, not hop.out)
                if self.conditions.paths.ends(hop, {t.label}):
                    df, c = self.conditions.on_nodes(Count(Source(hop), Bool(True), True, 1), t, df)
                    parts.append(c)
        if not parts:
            return None
        keep = parts[0]
        for p in parts[1:]:
            keep = keep | p
        return df.where(keep)

    # -- rows
    def empty(self) -> DataFrame:
        return self.graph.spark.createDataFrame([], SCHEMA)

    @staticmethod
    def _message(text: Column, key: Column, value: Column) -> Column:
        out = text
        for mark, c in (("{$this}", key), ("{?this}", key), ("{$value}", value), ("{?value}", value)):
            out = F.replace(out, F.lit(mark), F.coalesce(c, F.lit("")))
        return out

    def _rows(self, rule: Rule, df: DataFrame, value: Column, details: Column, node: tuple[Column, Column] | None = None) -> DataFrame:
        """``node``: label and key of the value, if it is a node."""
        message = F.lit(rule.message)
        if "{" in rule.message:
            message = self._message(message, F.col(KEY), value)
        fixed = {"rule_id": rule.rule_id, "rule_name": rule.name, "shape": rule.shape, "path": rule.path, "constraint": rule.constraint, "severity": rule.severity}
        label, key = node or (_nothing(), _nothing())
        return df.select(
            *(F.lit(v).cast("string").alias(k) for k, v in fixed.items()), F.col(LABEL).alias("focus_label"), F.col(KEY).alias("focus_key"), F.col(ID).cast("string").alias("focus_id"), F.col(START).alias("focus_start"), F.col(END).alias("focus_end"),
            value.cast("string").alias("value"), label.alias("value_label"), key.alias("value_key"), message.alias("message"), details.alias("details"), F.col(PROPERTIES).alias("properties"),
        )

    @staticmethod
    def _no_details() -> Column:
        return F.array().cast("array<string>")

    def _failed(self, rule: Rule, conditions: list[Column]) -> Column:
        if not conditions:
            return self._no_details()
        return F.array_compact(F.array(*(F.when(~c, F.lit(d.rule_id)) for c, d in zip(conditions, rule.details))))

    def violations(self, rule: Rule) -> DataFrame:
        """All violations of one rule."""
        if rule.status != "compiled":
            return self.empty()
        found = [self._told_apart(self._violations(rule, f), f) for f in self.focus(rule)]
        return union(found) if found else self.empty()

    @staticmethod
    def _told_apart(rows: DataFrame, f: FocusTable) -> DataFrame:
        """Violations of equal parallel relationships without a key, their ids numbered from the second on. Equal
        rows are counted, before they are shuffled too, and made again from the count in blocks: no window has to
        hold them. Equal relationships break the same rules, so a number means the same in all of them."""
        if not f.equal_rows:
            return rows
        counted = rows.groupBy(*COLUMNS).agg(F.count(F.lit(1)).alias("__n"))
        counted = counted.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / BLOCK).cast("long"))))
        each = F.sequence(F.col("__b") * BLOCK + 1, F.least(F.col("__n"), (F.col("__b") + 1) * BLOCK))
        told = F.when(F.col("__k") == 1, F.col("focus_id")).otherwise(F.concat("focus_id", F.lit("."), F.col("__k").cast("string")))
        return counted.withColumn("__k", F.explode(each)).withColumn("focus_id", told).select(*COLUMNS)

    def _violations(self, rule: Rule, f: FocusTable) -> DataFrame:
        t = f.table
        if rule.source is None or rule.source.is_self:
            df = self.conditions.failing(rule.holds, t, f.df)
            tests = []
            for d in rule.details:
                df, x = self.conditions.on_nodes(d.holds, t, df)
                tests.append(x)
            failed = self._failed(rule, tests)
            return self._rows(rule, df, F.lit(None), failed) if rule.source is None else self._rows(rule, df, F.col(ID), failed, (F.col(LABEL), F.col(KEY)))
        if rule.source.hops is None:
            if one := self._scalar(rule, t):
                return self._rows(rule, f.df.where(one[0]), one[1], one[2])
            rows = f.df.select(*CARRIED, F.explode(self._failing_values(rule, t)).alias("x"))
            return self._rows(rule, rows, F.col("x.value"), F.col("x.details"))
        return self._over_hops(rule, f)

    def _scalar(self, rule: Rule, t: NodeTable) -> tuple[Column, Column, Column] | None:
        """For values of one scalar column: a filter that reaches the scan instead of an exploded array, the value
        and the details."""
        kinds = [(n, t.properties[n]) for n in rule.source.properties if n in t.properties]
        if len(kinds) != 1 or kinds[0][1] == "ANY" or kinds[0][1].startswith("LIST<"):
            return None
        x, kind = t.value(kinds[0][0]), kinds[0][1]
        details = self._failed(rule, [value_condition(d.holds, x, kind) for d in rule.details])
        return x.isNotNull() & ~value_condition(rule.holds, x, kind, known=True), shown(x, kind), details

    def _failing_values(self, rule: Rule, t: NodeTable) -> Column:
        """array<struct<value, details>> of a focus's distinct values that fail."""
        parts = []
        for v in property_values(t, rule.source.properties, rule.source.whole):
            parts.append(F.transform(F.filter(v.array, tester(rule.holds, v.kind, False)), self._explained(rule, v.kind)))
        if not parts:
            return F.array().cast("array<struct<value:string,details:array<string>>>")
        single = len(parts) == 1 and not any(k.startswith("LIST<") or k == "ANY" for n in rule.source.properties if (k := t.properties.get(n)))
        return parts[0] if single else F.array_distinct(F.concat(*parts))

    def _explained(self, rule: Rule, kind: str):
        return lambda x: F.struct(shown(x, kind).alias("value"), self._failed(rule, [value_condition(d.holds, x, kind) for d in rule.details]).alias("details"))

    def _over_hops(self, rule: Rule, f: FocusTable) -> DataFrame:
        c, source, t = self.conditions, rule.source, f.table
        found = []
        for end in c.end_tables(source, t):
            if source.nodes:
                df, ok = c.on_nodes(rule.holds, end, c.nodes(end))
                tests = []
                for d in rule.details:
                    df, x = c.on_nodes(d.holds, end, df)
                    tests.append(x)
                found.append(df.where(~ok).select(F.lit(end.label).alias("el"), F.col(ID).alias("eid"), F.col(ID).cast("string").alias("value"), self._key(end).alias("vk"), self._failed(rule, tests).alias("details")))
            else:
                rows = c.nodes(end).select(ID, F.explode(self._failing_values(rule, end)).alias("x"))
                found.append(rows.select(F.lit(end.label).alias("el"), F.col(ID).alias("eid"), F.col("x.value").alias("value"), F.col("x.details").alias("details")))
        if not found:
            return self.empty()
        bad = union(found)
        pairs = c.paths.pairs(source.hops, t.label)
        keep = ["sid", "el", "eid", "value", "vk", "details"] if source.nodes else ["sid", "value", "details"]
        pairs = pairs.join(bad, ["el", "eid"]).select(*keep).distinct()
        df = f.df.select(*CARRIED).join(pairs, F.col(ID) == F.col("sid"))
        return self._rows(rule, df, F.col("value"), F.col("details"), (F.col("el"), F.col("vk")) if source.nodes else None)

    # -- fused scans
    def fused(self, rules: list[Rule]) -> list[tuple[list[Rule], DataFrame]]:
        """Groups of rules with the frame of all their violations. Rules of a group have the same focus
        and leave their focus table nowhere, so each table is scanned once for all of them."""
        groups: dict[tuple, list[Rule]] = {}
        alone = []
        for r in rules:
            if r.status != "compiled":
                continue
            if joins_needed(r):
                alone.append(r)
            else:
                groups.setdefault((r.focus, r.key), []).append(r)
        out, ways = [], {}
        for r in alone:
            ways.setdefault((r.focus, r.key, way(r)) if way(r) else (r.rule_id,), []).append(r)
        for group in ways.values():
            if len(group) == 1:
                out.append((group, self.violations(group[0])))
            else:
                frames = [self._along(group, f) for f in self.focus(group[0])]
                out.append((group, union(frames) if frames else self.empty()))
        for group in groups.values():
            if len(group) == 1:
                out.append((group, self.violations(group[0])))
                continue
            frames = [self._told_apart(self._scan(group, f), f) for f in self.focus(group[0])]
            out.append((group, union(frames) if frames else self.empty()))
        return out

    def _along(self, rules: list[Rule], f: FocusTable) -> DataFrame:
        """Rules over the nodes at the end of one path: its pairs are found once, different ones are counted in one
        aggregate with a condition for each rule, and pairs whose end fails are listed from the same exchange."""
        c, t, hops = self.conditions, f.table, way(rules[0])
        counts = [(k, r) for k, r in enumerate(rules) if r.source is None]
        values = [(k, r) for k, r in enumerate(rules) if r.source is not None]
        wanted = [r.holds.n if r.holds.least else r.holds.n + 1 for _, r in counts]
        enough = max(wanted) if not values and all(r.holds.filter == Bool(True) for _, r in counts) else None
        pairs = c.paths.pairs(hops, t.label, enough).select("sid", "el", "eid")
        pairs = pairs.distinct() if counts and enough is None else pairs
        filtered = [(k, r) for k, r in counts if r.holds.filter != Bool(True)]
        marked = pairs
        if filtered or values:
            ends = []
            for end in c.end_tables(Source(hops), t):
                df, flags, failed = c.nodes(end), [], []
                for k, r in filtered:
                    df, x = c.on_nodes(r.holds.filter, end, df)
                    flags.append(x.alias(f"f{k}"))
                for k, r in values:
                    df, x = c.on_nodes(r.holds, end, df)
                    tests = []
                    for d in r.details:
                        df, y = c.on_nodes(d.holds, end, df)
                        tests.append(y)
                    failed.append(F.when(~x, F.struct(F.lit(k).alias("k"), self._failed(r, tests).alias("details"))))
                failed = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<struct<k:int,details:array<string>>>")
                df = df.select(F.lit(end.label).alias("el"), F.col(ID).alias("eid"), self._key(end).alias("vk"), *flags, failed.alias("failed"))
                telling = F.size("failed") > 0
                for k, _ in filtered:
                    telling = telling | F.col(f"f{k}")
                ends.append(df.where(telling))
            if ends:
                marked = pairs.join(union(ends), ["el", "eid"], "left")
        found = []
        if counts:
            number = lambda k, r: F.count(F.lit(1)) if r.holds.filter == Bool(True) else F.count(F.when(F.col(f"f{k}"), 1)) if f"f{k}" in marked.columns else F.sum(F.lit(0))
            if enough is None:
                counted = (marked if filtered else pairs).groupBy("sid").agg(*(number(k, r).alias(f"n{k}") for k, r in counts))
            else:  # none of the rules tells more than so many ends apart
                counted = counted_up_to(pairs, enough, "el", "eid").select("sid", *(F.col("n").alias(f"n{k}") for k, _ in counts))
            df = f.df.select(*CARRIED).join(counted, F.col(ID) == F.col("sid"), "left")
            n = lambda k: F.coalesce(F.col(f"n{k}"), F.lit(0))
            broken = [F.when(n(k) < r.holds.n if r.holds.least else n(k) > r.holds.n, F.lit(k)) for k, r in counts]
            rows = df.select(*CARRIED, F.explode(F.array_compact(F.array(*broken))).alias("k"))
            found.append(rows.select(*CARRIED, "k", _nothing().alias("value"), self._no_details().alias("details"), _nothing().alias("vl"), _nothing().alias("vk")))
        if values and "failed" in marked.columns:
            bad = marked.where(F.size("failed") > 0).select("sid", "el", "eid", "vk", F.explode("failed").alias("x"))
            bad = bad if counts else bad.distinct()  # few of the pairs
            df = f.df.select(*CARRIED).join(bad, F.col(ID) == F.col("sid"))
            found.append(df.select(*CARRIED, F.col("x.k").alias("k"), F.col("eid").cast("string").alias("value"), F.col("x.details").alias("details"), F.col("el").alias("vl"), "vk"))
        if not found:
            return self.empty()
        return self._named(rules, union(found), F.col("vl"), F.col("vk"))

    def _named(self, rules: list[Rule], rows: DataFrame, label: Column, key: Column) -> DataFrame:
        """Rows with the place k of their rule as violations; ``label`` and ``key``: those of a value that is a node."""
        names = COLUMNS[:6] + ["message"]
        fixed = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(names, (r.rule_id, r.name, r.shape, r.path, r.constraint, r.severity, r.message)))) for r in rules))
        rows = rows.withColumns({"vl": label, "vk": key}).withColumn("r", fixed[F.col("k")])
        message = self._message(F.col("r.message"), F.col(KEY), F.col("value")) if any("{" in r.message for r in rules) else F.col("r.message")
        return rows.select(
            *(F.col(f"r.{c}") for c in COLUMNS[:6]), F.col(LABEL).alias("focus_label"), F.col(KEY).alias("focus_key"), F.col(ID).cast("string").alias("focus_id"), F.col(START).alias("focus_start"), F.col(END).alias("focus_end"),
            "value", F.col("vl").alias("value_label"), F.col("vk").alias("value_key"), message.alias("message"), "details", F.col(PROPERTIES).alias("properties"),
        )

    def _scan(self, rules: list[Rule], f: FocusTable) -> DataFrame:
        t, parts, filters = f.table, [], []
        for k, r in enumerate(rules):
            if r.source is None or r.source.is_self:
                _, ok = self.conditions.on_nodes(r.holds, t, f.df)
                tests = [self.conditions.on_nodes(d.holds, t, f.df)[1] for d in r.details]
                row = F.struct(F.lit(k).alias("k"), (F.col(ID).cast("string") if r.source is not None else _nothing()).alias("value"), self._failed(r, tests).alias("details"))
                parts.append(F.array(F.when(~ok, row)))
                filters.append(~ok)
            elif one := self._scalar(r, t):
                parts.append(F.array(F.when(one[0], F.struct(F.lit(k).alias("k"), one[1].alias("value"), one[2].alias("details")))))
                filters.append(one[0])
            else:
                parts.append(F.transform(self._failing_values(r, t), _numbered(k)))
        # if every rule has a plain condition, rows that break none of them are dropped at the scan
        df = f.df.where(reduce(Column.__or__, filters)) if len(filters) == len(rules) else f.df
        rows = df.select(*CARRIED, F.explode(F.array_compact(F.concat(*parts))).alias("x")).select(*CARRIED, "x.*")
        own = F.array(*(F.lit(r.source is not None and r.source.is_self) for r in rules))[F.col("k")]
        return self._named(rules, rows, F.when(own, F.col(LABEL)), F.when(own, F.col(KEY)))

    # -- results of many rules
    def all_violations(self, rules: list[Rule]) -> DataFrame:
        frames = [df for _, df in self.fused(rules)]
        return union(frames) if frames else self.empty()

    def summary(self, rules: list[Rule], sample_size: int = 5) -> DataFrame:
        """One row for each compiled rule, silent ones included: rule_id, severity, violation_count, sample (the
        focuses of its first violations by label, key and id)."""
        rows = self.all_violations(rules)
        counts = rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("violation_count"))
        focus = F.struct("nth", F.col("focus_label").alias("label"), F.col("focus_key").alias("key"), F.col("focus_id").alias("id"))
        listed = first_of_each(rows, sample_size).groupBy("rule_id").agg(F.sort_array(F.collect_list(focus)).alias("listed"))
        counts = counts.join(listed, "rule_id", "left")
        every = self.graph.spark.createDataFrame([(r.rule_id, r.severity) for r in rules if r.status == "compiled"], "rule_id string, severity string")
        return every.join(counts, "rule_id", "left").select(
            "rule_id", "severity", F.coalesce("violation_count", F.lit(0)).cast("long").alias("violation_count"),
            F.transform(F.coalesce("listed", F.array()), lambda x: F.struct(x["label"].alias("label"), x["key"].alias("key"), x["id"].alias("id"))).alias("sample"),
        )

