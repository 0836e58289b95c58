"""N-Triples as data: a splittable reader, and a distributed projection to node and relationship tables.

``read`` parses lines where Spark's text reader splits them, in JVM expressions alone. ``project`` writes a property
graph: a node belongs to the table of its first class by name (without one: ``resource``), with all its classes in
the column ``@labels``, its IRI in ``@id`` and the IRI's local name in ``@name`` (a node key for shapes that name
nodes); literals become list columns by the local names of their
predicates, typed where all literals of a predicate have one datatype and are well formed, VARIANT otherwise;
objects that are IRIs or blank nodes become relationships, named by UPPER_SNAKE of the predicate. Blank nodes are
kept apart by file. Repeated triples count once, as in any set of triples.

Only the vocabulary (classes, predicates, datatypes) reaches the driver. Each node table is one aggregate over the
literals of its label, the relationships are one write partitioned by type and labels; hubs and frequent
predicates are ordinary skewed join keys for AQE.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError
from ..functions.names import column
from ..jobs import at_once
from .turtle import RDF, XSD

TYPE = RDF + "type"
SIGN = "\x01"
_IRI = r'<([^\x00-\x20<>"{}|^`]+)>'
_BLANK = r'_:[^\s<>"]*[^\s<>".]'
#: A quote ends a literal unless an odd number of backslashes stands before it.
_ENDS = r'(?<!(?<!\\)(?:\\\\){0,200}\\)"'
_LINE = rf"""^\s*(?:{_IRI}|({_BLANK}))\s*{_IRI}\s*(?:{_IRI}|({_BLANK})|"(.*?){_ENDS}(?:\^\^{_IRI}|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)\s*\.\s*(?:#.*)?$"""
_KNOWN = r'\\[tbnrf"\'\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}'
_ESCAPES = {"\\t": "\t", "\\b": "\b", "\\n": "\n", "\\r": "\r", "\\f": "\f", '\\"': '"', "\\'": "'", "\\\\": "\\"}


def _plain(x: Column) -> Column:
    """Text without escapes."""
    named = F.create_map(*(F.lit(v) for pair in _ESCAPES.items() for v in pair))
    sign = lambda t: F.when(t.startswith("\\u"), F.decode(F.unhex(F.substring(t, 3, 8)), "UTF-16BE")).when(t.startswith("\\U"), F.decode(F.unhex(F.substring(t, 3, 8)), "UTF-32")).when(t.startswith("\\"), named[t]).otherwise(t)
    parts = F.regexp_extract_all(x, F.lit(rf"{_KNOWN}|[^\\]+"), 0)
    return F.when(x.contains("\\"), F.array_join(F.transform(parts, sign), "")).otherwise(x)


def read(spark: SparkSession, paths: str | list[str], mode: str = "FAILFAST") -> DataFrame:
    """Triples of N-Triples files: s, p, o, kind (iri, blank, literal: of o), datatype, lang. Empty lines and
    comments are skipped; any other line that is no triple fails the job, or with mode DROPMALFORMED is left out."""
    if mode not in ("FAILFAST", "DROPMALFORMED"):
        raise SourceError(f"unknown mode {mode}")
    lines = spark.read.text(paths).select("value", F.hex(F.xxhash64("_metadata.file_path")).alias("file")).where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    # one match a line: the groups are taken apart by a sign that only the literal, which comes last, may hold
    marks = SIGN.join(f"${k}" for k in (1, 2, 3, 4, 5, 7, 8, 6))
    cut = lines.withColumn("x", F.split(F.regexp_replace("value", _LINE, SIGN + marks), SIGN, 9))
    x = F.col("x")
    literal = x[8]
    unknown = F.regexp_replace(literal, _KNOWN, "").contains("\\") | F.regexp_replace(literal, _KNOWN, "").contains('"')
    good = (F.size("x") == 9) & (x[0] == "") & ~(literal.rlike(r'[\\"]') & unknown)
    if mode == "FAILFAST":
        cut = cut.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not N-Triples: "), F.substring("value", 1, 200)))))
    else:
        cut = cut.where(good)
    blank = lambda b: F.concat(F.lit("_:"), F.col("file"), F.lit("."), F.substring(b, 3, 1 << 30))
    cut = cut.withColumn("kind", F.when(x[4] != "", "iri").when(x[5] != "", "blank").otherwise("literal"))
    return cut.select(
        F.when(x[2] != "", blank(x[2])).otherwise(_plain(x[1])).alias("s"), _plain(x[3]).alias("p"),
        F.when(F.col("kind") == "blank", blank(x[5])).when(F.col("kind") == "iri", _plain(x[4])).otherwise(_plain(literal)).alias("o"), "kind",
        F.when(F.col("kind") == "literal", F.when(x[7] != "", F.lit(RDF + "langString")).when(x[6] != "", _plain(x[6])).otherwise(F.lit(XSD + "string"))).alias("datatype"),
        F.when(x[7] != "", x[7]).alias("lang"),
    )


def local_name(iri: Column) -> Column:
    name = F.regexp_extract(iri, r"([^/#:]+)[/#]*$", 1)
    return F.when(name == "", iri).otherwise(name)


def upper_snake(name: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"([A-Z])([A-Z][a-z])", "$1_$2"), r"[^A-Za-z0-9]+", "_"))


_INTEGERS = ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
#: Spark types by the local name of an XSD datatype, and the lexical forms that are cast; all others are text.
_TYPES = {
    **dict.fromkeys(_INTEGERS, ("bigint", r"^[+-]?[0-9]+$")), "boolean": ("boolean", "^(true|false|1|0)$"), "decimal": ("decimal(38,18)", r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"),
    **dict.fromkeys(("double", "float"), ("double", r"^([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN)$")), "date": ("date", r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}$"),
    "dateTime": ("timestamp_ntz", r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?$"), "dateTimeStamp": ("timestamp", r"^.*T.*(Z|[+-][0-9]{2}:[0-9]{2})$"),
}


def _typed(datatype: Column, o: Column) -> tuple[Column, Column]:
    """The Spark type of a literal, and whether it is well formed; a dateTime with a zone is a dateTimeStamp."""
    name = F.when(datatype.startswith(XSD), F.substring(datatype, len(XSD) + 1, 100)).otherwise(F.lit(""))
    name = F.when((name == "dateTime") & o.rlike(_TYPES["dateTimeStamp"][1]), F.lit("dateTimeStamp")).otherwise(name)
    kind, ok = F.lit("string"), F.lit(True)
    for xsd, (spark_type, form) in _TYPES.items():
        kind = F.when(name == xsd, F.lit(spark_type)).otherwise(kind)
        ok = F.when(name == xsd, o.rlike(form) & o.try_cast(spark_type).isNotNull()).otherwise(ok)
    return kind, F.coalesce(ok, F.lit(False))


def _value(kind: str) -> Column:
    """A literal's value as the type of its column."""
    if kind != "variant":
        return F.col("o").cast(kind)
    out = F.col("o").cast("variant")
    for spark_type in sorted({t for t, _ in _TYPES.values()}):
        out = F.when((F.col("type") == spark_type) & F.col("ok"), F.col("o").try_cast(spark_type).cast("variant")).otherwise(out)
    return out


def _unique(names: dict[str, set[str]], what: str) -> None:
    for name, iris in names.items():
        if len(iris) > 1:
            raise SourceError(f"{what} `{name}` stands for several predicates: {', '.join(sorted(iris))}")


def project(spark: SparkSession, triples: DataFrame, folder: str, resource: str = "Resource") -> dict:
    """Write the property graph of triples (``read``) into a folder that the cluster shares; returns the
    configuration for ``load_graph``. Language-tagged literals have no form in a property graph and are refused,
    as are predicates or classes whose names can't be told apart."""
    where = f"{folder.rstrip('/')}/"

    def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(where + name)
        return spark.read.schema(df.schema).parquet(where + name)

    triples = kept(triples.distinct(), "triples", "kind")
    links = triples.where("kind <> 'literal'")
    classes = links.where(F.col("p") == TYPE)
    found = triples.select(F.col("s").alias("id"), F.when(F.col("p") == TYPE, local_name(F.col("o"))).alias("class"))
    found = found.unionAll(links.where(F.col("p") != TYPE).select("o", F.lit(None).cast("string")))
    nodes = found.groupBy("id").agg(F.sort_array(F.collect_set("class")).alias("labels"))
    nodes = kept(nodes.select("id", F.coalesce(F.get("labels", F.lit(0)), F.lit(resource)).alias("label"), "labels"), "nodes")

    named = defaultdict(set)
    for r in classes.select("o", local_name(F.col("o")).alias("name")).distinct().collect():
        named[r.name.lower()].add(r.o)
    _unique(named, "class")
    kind, ok = _typed(F.col("datatype"), F.col("o"))
    literals = triples.where("kind = 'literal'").select("s", "p", "o", "datatype", "lang", kind.alias("type"), ok.alias("ok"))
    literals = kept(literals.join(nodes.withColumnRenamed("id", "s"), "s").select("s", "label", "p", "o", "lang", "type", "ok"), "literals")
    vocabulary = literals.groupBy("label", "p", local_name(F.col("p")).alias("name"), "type").agg(F.min("ok").alias("ok"), F.max(F.col("lang").isNotNull()).alias("tagged")).collect()
    for r in vocabulary:
        if r.tagged:
            raise SourceError(f"<{r.p}> has literals with language tags, which have no form in a property graph")
    columns: dict[str, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    for r in vocabulary:
        columns[r.label][r.p].append(r)
    sets = nodes.groupBy("label").agg(F.array_distinct(F.flatten(F.collect_set("labels"))).alias("carried")).collect()

    config: dict = {"nodes": [], "rels": []}
    writes = []
    for k, t in enumerate(sorted(sets)):
        names = defaultdict(set)
        for p, rows in columns[t.label].items():
            names[rows[0].name.lower()].add(p)
        _unique(names, f"{t.label}: property")
        rows = literals.where(F.col("label") == t.label).select("s", "p", "o", "type", "ok", F.lit(None).cast("array<string>").alias("labels"))
        rows = rows.unionAll(nodes.where(F.col("label") == t.label).select(F.col("id").alias("s"), *(F.lit(None).cast(c).alias(n) for n, c in (("p", "string"), ("o", "string"), ("type", "string"), ("ok", "boolean"))), "labels"))
        aggregates = [F.max("labels").alias("@labels")]
        for p, kinds in sorted(columns[t.label].items()):
            kind = kinds[0].type if len(kinds) == 1 and kinds[0].ok else "variant"
            aggregates.append(F.collect_list(F.when(F.col("p") == p, _value(kind))).alias(kinds[0].name))
        wide = rows.groupBy(F.col("s").alias("@id")).agg(*aggregates).withColumn("@name", local_name(F.col("`@id`")))
        writes.append(lambda wide=wide, k=k: kept(wide, f"label-{k}"))
        config["nodes"].append({"label": t.label, "path": f"{where}label-{k}", "key": "@id", "labels": "@labels", "carries": sorted(set(t.carried) - {t.label})})

    at_once(spark, writes, 8)
    ends = [nodes.select(F.col("id").alias(c), F.col("label").alias(x)) for c, x in (("s", "from"), ("o", "to"))]
    rels = links.where(F.col("p") != TYPE).join(ends[0], "s").join(ends[1], "o")
    rels = rels.select(F.col("s").alias("src"), F.col("o").alias("dst"), "p", upper_snake(local_name(F.col("p"))).alias("type"), "from", "to")
    named = defaultdict(set)
    kinds = set()
    # a sign in front keeps names that look like numbers text when partitions are found again
    rels = kept(rels.select("src", "dst", "p", *(F.concat(F.lit("_"), F.col(c)).alias(c) for c in ("type", "from", "to"))), "rels", "type", "from", "to")
    for r in rels.groupBy("type", "from", "to", "p").agg(F.count(F.lit(1))).collect():
        named[r["type"][1:]].add(r.p)
        kinds.add((r["type"], r["from"], r["to"]))
    _unique(named, "relationship")
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    for kind, a, b in sorted(kinds):
        sql = f"SELECT src, dst FROM parquet.`{where}rels` WHERE `type` = {quote(kind)} AND `from` = {quote(a)} AND `to` = {quote(b)}"
        config["rels"].append({"type": kind[1:], "from": a[1:], "to": b[1:], "sql": sql})
    return config


def _named(base: str, x: Column) -> Column:
    return F.concat(F.lit("<" + base), x.cast("string"), F.lit(">"))


def write(df: DataFrame, folder: str, subject: Column, klass: str, properties: dict[str, str], base: str = "http://example.org/") -> None:
    """Rows as N-Triples: a class and the named columns of each, as literals; nulls are left out."""
    escapes = (("\\\\", "\\\\\\\\"), ('"', '\\\\"'), ("\n", "\\\\n"), ("\r", "\\\\r"))
    xsd = {"bigint": "integer", "int": "integer", "smallint": "integer", "double": "double", "boolean": "boolean", "date": "date"}
    lines, types = [F.concat(_named(base, subject), F.lit(f" <{TYPE}> <{base}{klass}> ."))], dict(df.dtypes)
    for name, c in properties.items():
        text = column(c).cast("string")
        for sign, escaped in escapes:
            text = F.regexp_replace(text, sign, escaped)
        end = f'"^^<{XSD}{xsd[types[c]]}> .' if types[c] in xsd else '" .'
        lines.append(F.concat(_named(base, subject), F.lit(f' <{base}{name}> "'), text, F.lit(end)))
    df.select(F.explode(F.array_compact(F.array(*lines))).alias("value")).write.mode("overwrite").text(folder)


def write_links(df: DataFrame, folder: str, subject: Column, name: str, to: Column, base: str = "http://example.org/") -> None:
    """Rows as N-Triples between two nodes."""
    df.select(F.concat(_named(base, subject), F.lit(f" <{base}{name}> "), _named(base, to), F.lit(" ."))).write.mode("overwrite").text(folder)
