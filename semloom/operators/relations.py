"""Relations between columns: resolving property keys, finding pairs in the ontology, keeping and checking them.

A relation table has (property, iri, kind, subject, object), a row a pair of columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom import functions as S
from semloom.operators.ontology import closure, subclass_edges
from semloom.operators.serialize import Relation
from semloom.session import small
from semloom.terms import OWL, PREFIXES, RDF, RDFS

SCHEMA = "property string, iri string, kind string, subject string, object string"


def frame(spark: SparkSession, pairs: Mapping[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """(property, subject, object) of {property: [(subject column, object column)]}."""
    return spark.createDataFrame([(k, a, b) for k, v in pairs.items() for a, b in v], "property string, subject string, object string")


def resolve(keys: DataFrame, props: DataFrame, bindings: Mapping[str, str] = PREFIXES) -> DataFrame:
    """keys (property, ..) with iri and kind: by label, else as an IRI, else as prefix:rest that the ontology (props:
    label, iri, kind) knows. A key that none resolves keeps null for both."""
    by_label = small(props.groupBy("label").agg(F.min(F.struct("iri", "kind")).alias("l")))
    by_iri = small(props.groupBy("iri").agg(F.min("kind").alias("k")).withColumnRenamed("iri", "full"))
    k = keys.withColumn("full", S.expand("property", bindings))
    j = k.join(by_label, k.property == by_label.label, "left").join(by_iri, "full", "left")
    iri = F.coalesce("l.iri", F.when(F.col("k").isNotNull() | S.is_absolute("property"), F.col("full")))
    return j.select(*[c for c in keys.columns], iri.alias("iri"), F.coalesce("l.kind", "k").alias("kind"))


def add(relations: DataFrame, more: DataFrame) -> DataFrame:
    """Both, repeated pairs once."""
    return relations.unionByName(more).distinct()


def delete(relations: DataFrame, property: str, pairs: Sequence[tuple[str, str]] | None = None, bindings: Mapping[str, str] = PREFIXES) -> DataFrame:
    """relations without the property (given by key, IRI or prefix:rest), or without some of its pairs."""
    full = S.expand(F.lit(property), bindings)
    hit = (F.col("property") == property) | F.coalesce(F.col("iri") == property, F.lit(False)) | F.coalesce(F.col("iri") == full, F.lit(False))
    if pairs is not None:
        one = F.lit(False)
        for a, b in pairs:
            one = one | ((F.col("subject") == a) & (F.col("object") == b))
        hit = hit & one
    return relations.where(~hit)


def validate(relations: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(check, property, subject, object): properties that aren't resolved, and pairs with a column the table lacks."""
    unresolved = relations.where("iri is null").select(F.lit("unresolved_property").alias("check"), "property", F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("object")).distinct()
    have = list(columns)
    bad = lambda side: relations.where(~F.col(side).isin(*have)).select(F.lit(f"missing_{side}_column").alias("check"), "property", "subject", "object")
    return unresolved.union(bad("subject")).union(bad("object"))


def rows(relations: DataFrame) -> list[Relation]:
    """The relations on the driver, for serialisation: a row a pair of columns."""
    got = relations.orderBy("property", "subject", "object").collect()
    return [Relation(r["iri"] or r["property"], r["kind"], r["subject"], r["object"]) for r in got]


def range_members(onto: DataFrame) -> DataFrame:
    """(prop, range): named ranges of properties, and the members of ranges that are unions of a list."""
    ranges = onto.where(F.col("p") == f"{RDFS}range").select(F.col("s").alias("prop"), F.col("o").alias("range"), "o_kind")
    unions = onto.where(F.col("p") == f"{OWL}unionOf").select(F.col("s").alias("range"), F.col("o").alias("head"))
    rest = onto.where(F.col("p") == f"{RDF}rest").select(F.col("s").alias("child"), F.col("o").alias("parent"))
    first = onto.where(F.col("p") == f"{RDF}first").select(F.col("s").alias("cell"), F.col("o").alias("member"))
    cells = closure(rest).select(F.col("child").alias("head"), F.col("ancestor").alias("cell"))
    members = ranges.join(unions, "range").join(cells, "head").join(first, "cell").select("prop", F.col("member").alias("range"))
    return ranges.where("o_kind = 'iri'").select("prop", "range").union(members).distinct()


def discover(onto: DataFrame, columns: DataFrame) -> DataFrame:
    """(prop, subject, object): pairs of columns (column, iri of its type) that an object property may join: the subject
    column's type is its domain or below it, the object column's type in its range or below, columns differing."""
    datatype = onto.where((F.col("p") == f"{RDF}type") & (F.col("o") == f"{OWL}DatatypeProperty")).select(F.col("s").alias("prop"))
    domain = onto.where(F.col("p") == f"{RDFS}domain").select(F.col("s").alias("prop"), F.col("o").alias("domain")).join(datatype, "prop", "left_anti")
    up = closure(subclass_edges(onto)).select(F.col("child").alias("iri"), "ancestor")
    mine = columns.select("column", "iri").distinct()
    above = mine.join(up, "iri").select("column", "ancestor").union(mine.select("column", F.col("iri").alias("ancestor"))).distinct()
    s = above.select(F.col("column").alias("subject"), F.col("ancestor").alias("domain"))
    o = above.select(F.col("column").alias("object"), F.col("ancestor").alias("range"))
    pairs = domain.join(s, "domain").join(range_members(onto), "prop").join(o, "range")
    return pairs.where("subject <> object").select("prop", "subject", "object").distinct()


def text(relations: DataFrame) -> str:
    """A line a pair, by property; gathers the table, which a person reads."""
    out: list[str] = []
    last = None
    for r in relations.orderBy("property", "subject", "object").collect():
        if r["property"] != last:
            last = r["property"]
            out.append(f"{last} ({r['kind'] or 'unresolved'})")
        out.append(f"  {r['subject']} -> {r['object']}")
    return "\n".join(out)
