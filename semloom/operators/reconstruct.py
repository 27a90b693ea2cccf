"""Triples to tables, and the audits on the way.

One aggregation over (graph, subject) gathers all that is known of an entity; wide tables, first definitions, conflicts
and counts all come from that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semloom import functions as S
from semloom.operators.serialize import Entry, Relation, expand_name, local_type
from semloom.session import checkpoint, small
from semloom.terms import HELPERS, HOME, NO_DEFINITION, PREFIXES, QUDT, RDF, SKOS, UNIT, UNITLESS


def entities(triples: DataFrame, home: str = HOME) -> DataFrame:
    """(g, s, label, value, unit, type, definition, stage, note): every subject with a label, a row a graph.

    Of several values of a property the least counts, so the result doesn't depend on the order of triples."""

    def of(p: str, kind: str | None = None) -> Column:
        hit = F.col("p") == p
        return F.min(F.when(hit & (F.col("o_kind") == kind) if kind else hit, F.col("o")))

    wanted = {"label": f"{SKOS}altLabel", "value": f"{QUDT}value", "unit": f"{QUDT}hasUnit", "type": f"{RDF}type", "definition": f"{SKOS}definition", "stage": f"{home}hasStudyStage", "note": f"{SKOS}note"}
    some = triples.where(F.col("p").isin(*wanted.values()))
    return some.groupBy("g", "s").agg(*[of(p).alias(n) for n, p in wanted.items()]).where("label is not null")


def labels_of(found: DataFrame) -> list[str]:
    """The distinct labels, sorted: the columns of the wide table. There are as many as a table has columns."""
    return sorted(r["label"] for r in found.select("label").distinct().collect())


def wide(found: DataFrame, labels: Sequence[str] | None = None, source: str | None = "__source_file__") -> DataFrame:
    """A row a graph, a column a label. A label that a graph lacks is null; one that it has twice takes the value of the
    subject that sorts last. `source` names the column that holds the graph; None leaves it out."""
    labels = labels_of(found) if labels is None else list(labels)
    last = F.max_by("value", F.struct("s", "value"))
    # one shuffle serves both groupings of the pivot
    out = found.select("g", "s", "label", "value").repartition("g").groupBy("g").pivot("label", labels).agg(last) if labels else found.select("g").distinct()
    return out.withColumnRenamed("g", source) if source else out.drop("g")


def ordered_columns(columns: Sequence[str]) -> list[str]:
    """Alphabetical, helper columns at the end."""
    return sorted(c for c in columns if c not in HELPERS) + sorted(c for c in columns if c in HELPERS)


def first_definitions(found: DataFrame) -> DataFrame:
    """(label, type, unit, definition, stage, note, origin): what each label means where it comes first by graph and
    subject; origin is that graph."""
    first = F.min_by(F.struct("type", "unit", "definition", "stage", "note", F.col("g").alias("origin")), F.struct("g", "s"))
    return found.groupBy("label").agg(first.alias("d")).select("label", "d.*")


def definitions_of(triples: DataFrame, home: str = HOME) -> DataFrame:
    """first_definitions(entities(triples)), but only the labels of all entities are gathered and sorted; they tell which
    subject of each label comes first, and the rest is gathered of those few. The triples are read twice."""
    named = triples.where(F.col("p") == f"{SKOS}altLabel").groupBy("g", "s").agg(F.min("o").alias("label")).where("label is not null")
    first = named.groupBy("label").agg(F.min(F.struct("g", "s")).alias("at")).select(F.col("at.g").alias("_g_"), F.col("at.s").alias("_s_"))
    here = F.col("g").eqNullSafe(F.col("_g_")) & (F.col("s") == F.col("_s_"))
    found = entities(triples.join(small(checkpoint(first)), here, "left_semi"), home)
    return found.select("label", "type", "unit", "definition", "stage", "note", F.col("g").alias("origin"))


def template_entries(definitions: DataFrame) -> list[Entry]:
    """A template of what first_definitions found, by label; a row a column, gathered on the driver."""
    rows = definitions.orderBy("label").collect()
    return [Entry(r["label"], r["type"] or "home:" + r["label"], r["definition"] or NO_DEFINITION, (r["unit"] or UNITLESS).removeprefix(UNIT), r["stage"] or "", r["note"] or "") for r in rows]


def conflicts(found: DataFrame, template: Sequence[Entry] | None = None, bindings=PREFIXES, stored: bool = False) -> DataFrame:
    """(g, label, kind, expected, found, expected_from) of every entity whose unit or type isn't what the template says
    or, for labels that it lacks, what the label's first definition says. Types compare as full IRIs.

    The entities are read twice, so they are checkpointed, unless they are `stored` already."""
    spark = found.sparkSession
    found = found if stored else checkpoint(found.select("g", "s", "label", "type", "unit", "definition", "stage", "note"))
    given = spark.createDataFrame([(e.alt_label, expand_name(e.type, bindings), UNIT + e.unit if e.unit else None, "template") for e in template or ()], "label string, t string, u string, origin string")
    seen = first_definitions(found).select("label", F.col("type").alias("t"), F.col("unit").alias("u"), "origin")
    expected = given.unionByName(seen.join(F.broadcast(given.select("label")), "label", "left_anti"))
    both = found.join(small(checkpoint(expected)), "label")  # a row a label, of a pass over all entities
    issue = lambda kind, want, got: F.when(F.col(want).isNotNull() & F.col(got).isNotNull() & (F.col(want) != F.col(got)), F.struct(F.lit(kind).alias("kind"), F.col(want).alias("expected"), F.col(got).alias("found")))
    each = F.filter(F.array(issue("unit", "u", "unit"), issue("type", "t", "type")), lambda x: x.isNotNull())
    return both.select("g", "label", F.explode(each).alias("i"), F.col("origin").alias("expected_from")).select("g", "label", "i.*", "expected_from")


def relation_conflicts(triples: DataFrame, found: DataFrame, relations: Sequence[Relation], bindings=PREFIXES) -> DataFrame:
    """(g, property, subject, object, kind): pairs of columns that a graph holds both of (the object with a value, for
    datatype properties) without the triple that the relation asks for between the two instances."""
    spark = triples.sparkSession
    asked = spark.createDataFrame([(expand_name(r.property, bindings), r.kind, r.subject, r.object) for r in relations if r.kind], "property string, kind string, subject string, object string")
    a = found.select("g", F.col("s").alias("s1"), F.col("label").alias("subject"), F.col("value").alias("v1"))
    b = found.select("g", F.col("s").alias("s2"), F.col("label").alias("object"), F.col("value").alias("v2"))
    pairs = a.join(F.broadcast(asked), "subject").where("v1 is not null").join(b, ["g", "object"]).where("v2 is not null")
    pairs = pairs.withColumn("o", F.when(F.col("kind") == "object", F.col("s2")).otherwise(F.col("v2")))
    have = triples.select("g", F.col("s").alias("s1"), F.col("p").alias("property"), "o")
    return pairs.join(have, ["g", "s1", "property", "o"], "left_anti").select("g", "property", "subject", "object", F.lit("missing").alias("kind"))


def conflict_counts(issues: DataFrame) -> DataFrame:
    """(kind, n)."""
    return issues.groupBy("kind").agg(F.count("*").alias("n"))


def report(issues: DataFrame, relations: DataFrame | None = None) -> str:
    """The audits as text. Gathers a line an issue, so it is for the imports that a person reads."""
    rows = issues.orderBy("label", "g", "kind").collect()
    lines = [f"{len(rows)} conflicts of units and types"]
    lines += [f"- {r['label']} in {r['g']}: {r['kind']} {r['found']}, expected {r['expected']} ({r['expected_from']})" for r in rows]
    if relations is not None:
        missing = relations.orderBy("property", "g").collect()
        lines.append(f"{len(missing)} missing relations")
        lines += [f"- {r['g']}: {r['subject']} {r['property']} {r['object']}" for r in missing]
    return "\n".join(lines) + "\n"


def with_header_rows(table: DataFrame, template: Sequence[Entry], order: str) -> DataFrame:
    """The table as text with three rows of types, units and study stages before it, and a __Label__ column: "Type",
    "Units", "Study Stage", then 1, 2, ... by `order`, a unique column. __row__ has the rows' order."""
    from semloom.session import numbered

    spark = table.sparkSession
    said = {e.alt_label: e for e in template}
    columns = [c for c in ordered_columns(table.columns) if c != "__Label__"]
    part = {"Type": lambda e: e.type, "Units": lambda e: f"unit:{e.unit}" if e.unit else None, "Study Stage": lambda e: e.stage}
    head = [(i, name, *(f(said[c]) if c in said else None for c in columns)) for i, (name, f) in enumerate(part.items(), -2)]
    ddl = ", ".join(f"`{c}` string" for c in columns)
    rows = numbered(table, [order], "__row__").select(F.col("__row__").cast("bigint").alias("__row__"), F.col("__row__").cast("string").alias("__Label__"), *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return spark.createDataFrame(head, f"__row__ bigint, __Label__ string, {ddl}").unionByName(rows)


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n, n_null): one pass over the table, one row a column."""
    counts = df.agg(F.count("*").alias("_n_"), *[F.count(F.when(~S.is_blank(F.col(f"`{c}`")), 1)).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("_n_").alias("n"), (F.col("_n_") - F.col(f"`{c}`")).alias("n_null")) for c in df.columns]))
    return counts.select(pairs.alias("p")).select("p.*")


def outer_union(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, columns that one lacks null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def type_names(found: DataFrame) -> DataFrame:
    """(label, type_name): each label's local type names, sorted."""
    return found.groupBy("label").agg(F.array_sort(F.collect_set(S.fragment("type"))).alias("type_name"))


def occurrence(found: DataFrame) -> DataFrame:
    """found with nth: which occurrence of its label an entity is, by graph and subject."""
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy("g", "s")))


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"annotations", "local_type"}]
