"""Tables to triples.

A row becomes one entity a described column. The row key is a projection over the template's columns, the cells are
unpivoted, and the template (one row a triple of a column) is joined by broadcast: a narrow pipeline, after the rows of
a table in few parts are spread over the cores, without a shuffle until a caller asks for a distinct union.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semloom import functions as S
from semloom.session import small, spread
from semloom.terms import CURATORS_AT, DCT, ENTITY_IRI, HELPERS, HOME, NO_DEFINITION, NO_ORCID, PREFIXES, PROV, QUDT, RDF, RDFS, SKOS, TRIPLE_COLUMNS, UNIT, UNITLESS, XSD

#: Where the object of an entity's triple is found, unless it is a place among the row's own ones.
_SAME, _KEY, _LICENSE = -1, -2, -3
UNVERIFIED = "Caution: the data curator's ORCID was not verified when this was serialised."


class Entry(NamedTuple):
    """What a template says of a column."""

    alt_label: str
    type: str
    definition: str | None = NO_DEFINITION
    unit: str | None = UNITLESS
    stage: str | None = ""
    note: str | None = ""
    note_lang: str | None = "en"
    generated_at: str | None = None
    id: str | None = None


class Relation(NamedTuple):
    """A property between two columns; kind is "object", "datatype", or None for one that isn't known, which gives no
    triples."""

    property: str
    kind: str | None
    subject: str
    object: str


def datatype_of(kind: T.DataType) -> str | None:
    """Datatype IRI of a column's values as native literals; None for plain strings."""
    if isinstance(kind, T.BooleanType):
        return f"{XSD}boolean"
    if isinstance(kind, T.IntegralType):
        return f"{XSD}integer"
    if isinstance(kind, T.DecimalType):
        return f"{XSD}decimal"
    if isinstance(kind, T.FractionalType):
        return f"{XSD}double"
    if isinstance(kind, T.DateType):
        return f"{XSD}date"
    return f"{XSD}dateTime" if isinstance(kind, T.TimestampType | T.TimestampNTZType) else None


def triple(s: Column, p: str | Column, o: Column | str, kind: str = "lit", dt: Column | str | None = None, lang: Column | str | None = None) -> Column:
    """A struct (s, p, o, o_kind, o_dt, o_lang)."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(s.alias("s"), c(p).alias("p"), c(o).alias("o"), c(kind).alias("o_kind"), c(dt).alias("o_dt"), c(lang).alias("o_lang"))


def emit(rows: DataFrame, graph: Column | str | None, triples: Sequence[Column]) -> DataFrame:
    """The triples of each row whose subject and object aren't null."""
    g = F.lit(None).cast("string") if graph is None else F.col(graph) if isinstance(graph, str) else graph
    return rows.select(g.alias("g"), F.explode(F.array(*triples)).alias("t")).select("g", "t.*").where("s is not null and o is not null")


def cell_text(df: DataFrame, column: str) -> Column:
    """A cell as text; null where it is null, NaN or blank."""
    return F.when(~S.is_blank(F.col(f"`{column}`")), F.col(f"`{column}`").cast("string"))


def key_column(template: Sequence[Entry], key_columns: Sequence[str] | None = None) -> Column:
    """The row key: of the given columns (in that order, as far as the template has them), else by study stage."""
    labels = [e.alt_label for e in template]
    chosen = [c for c in key_columns or () if c in labels]
    if chosen:
        return S.key_from_columns([F.col(f"`{c}`") for c in chosen])
    stages: dict[str, list[Column]] = {}
    for e in template:
        stages.setdefault(e.stage or "", []).append(F.col(f"`{e.alt_label}`"))
    return S.row_key(stages)


def local_type(type_: str) -> str:
    t = type_.strip()
    return t.rsplit("/", 1)[-1].rsplit("#", 1)[-1] if "://" in t else t.split(":", 1)[-1]


def expand_name(name: str, bindings: Mapping[str, str]) -> str:
    if "://" in name:
        return name
    prefix, colon, rest = name.partition(":")
    return bindings[prefix] + rest if colon and prefix in bindings else bindings.get("home", HOME) + (rest if colon else name)


def guarded(template: Sequence[Entry], classes: Sequence[str] | None, bindings: Mapping[str, str] = PREFIXES) -> list[list[str]]:
    """Type IRIs of each entry, all columns of one subject considered: if any of a subject's types isn't a known class,
    the subject is a plain entity. Subjects share their local type name, so the template alone decides."""
    full = [expand_name(e.type, bindings) for e in template]
    if classes is None:
        return [[t] for t in full]
    known, names = set(classes), [local_type(e.type) for e in template]
    bad = {n for n, t in zip(names, full, strict=True) if t not in known}
    return [[ENTITY_IRI] if n in bad else [t] for n, t in zip(names, full, strict=True)]


def table_triples(
    df: DataFrame,
    template: Sequence[Entry],
    *,
    orcid: str = NO_ORCID,
    verified: bool = True,
    key_columns: Sequence[str] | None = None,
    id_columns: Sequence[str] = (),
    label_pairs: Sequence[tuple[str, str]] = (),
    relations: Sequence[Relation] = (),
    license: str | None = None,
    licenses: Sequence[str] | None = None,
    classes: Sequence[str] | None = None,
    base: str = HOME,
    row_column: str | None = None,
    generated_at: str | None = None,
    bindings: Mapping[str, str] = PREFIXES,
) -> DataFrame:
    """Triples (terms.TRIPLES) of every row of df; g is the row's graph.

    Cells that are null, NaN or blank give no value but all else of their entity. A template column that the table lacks
    counts as null. An id column's entity is named after its cell, and left out where that is empty; all others after
    the row key. Helper columns are never described. classes: the ontology's class IRIs; types outside become plain
    entities (see guarded). row_column: a row number that keeps graphs of equal keys apart."""
    template = [e for e in template if e.alt_label not in HELPERS]
    if any(not e.alt_label or not e.type for e in template):
        raise ValueError("every template entry needs a label and a type")
    missing = [e.alt_label for e in template if e.alt_label not in df.columns]
    for c in dict.fromkeys([*missing, *(r.object for r in relations if r.object not in df.columns), *(b for _, b in label_pairs if b not in df.columns)]):
        df = df.withColumn(c, F.lit(None).cast("string"))
    types = guarded(template, classes, bindings)
    key = key_column(template, key_columns)
    names = {e.alt_label: local_type(e.type) for e in template}

    def subject(label: str) -> Column:
        own = F.col("_key_")
        if label in id_columns:
            found = S.entity_id(cell_text(df, label))
            own = F.when(found != "", found)
        return F.concat(F.lit(base + names[label] + "."), own)

    def native(column: str) -> tuple[Column, str | None]:
        kind = df.schema[column].dataType
        c = F.col(f"`{column}`")
        return (S.iso_instant(c) if isinstance(kind, T.TimestampType) else c.cast("string")), datatype_of(kind)

    extra: dict[str, list[tuple[str, Column, str, str | None]]] = {}
    for a, b in label_pairs:
        if a in names:
            extra.setdefault(a, []).append((f"{RDFS}label", F.trim(cell_text(df, b)), "lit", None))
    for r in relations:
        if r.subject not in names or r.kind is None:
            continue
        p, (value, dt) = expand_name(r.property, bindings), native(r.object)
        there = F.col(f"`{r.subject}`").isNotNull() & F.col(f"`{r.object}`").isNotNull()
        if r.kind == "object":
            o = subject(r.object) if r.object in names else F.concat(F.lit(base), S.percent_encode(F.trim(value)))
            extra.setdefault(r.subject, []).append((p, F.when(there, o), "iri", None))
        else:
            extra.setdefault(r.subject, []).append((p, F.when(there, value), "lit", dt))

    # objects that a row has of its own: the cell, then label pairs and relations, by place
    own = lambda e: F.array(cell_text(df, e.alt_label), *[o.cast("string") for _, o, *_ in extra.get(e.alt_label, ())])
    cells = [F.struct(F.lit(i).alias("ordinal"), subject(e.alt_label).alias("s"), own(e).alias("own")) for i, e in enumerate(template)]
    full = S.full_row_key(F.col("_key_"), F.lit(orcid))
    graph = F.concat(F.lit(base), full, *([F.col(row_column).cast("string")] if row_column else []))
    rows = spread(df).withColumn("_key_", key).select(graph.alias("g"), "_key_", F.explode(F.array(*cells)).alias("c")).select("g", "_key_", "c.*").where("s is not null")

    # a row a triple of an entity: its object as far as it is the same for all, else where it is found
    said = []
    for i, (e, t) in enumerate(zip(template, types, strict=True)):
        same = [
            (f"{RDF}type", t[0], "iri", None, None),
            (f"{SKOS}altLabel", e.alt_label, "lit", None, None),
            (f"{SKOS}definition", e.definition, "lit", None, None),
            (f"{QUDT}hasUnit", (UNIT + e.unit) if e.unit else None, "iri", None, None),
            (f"{PROV}generatedAtTime", generated_at or e.generated_at, "lit", f"{XSD}dateTime", None),
            (f"{SKOS}note", e.note, "lit", None, e.note_lang),
            (f"{base}hasStudyStage", e.stage, "lit", None, None),
            (f"{DCT}creator", CURATORS_AT + orcid, "iri", None, None),
            (f"{SKOS}note", None if verified else UNVERIFIED, "lit", None, None),
        ]
        said += [(i, _SAME, p, o, kind, dt, lang) for p, o, kind, dt, lang in same if o is not None]
        said += [(i, _KEY, f"{base}row", None, "lit", None, None), (i, _LICENSE, f"{DCT}license", None, "iri", None, None), (i, 0, f"{QUDT}value", None, "lit", None, None)]
        said += [(i, at, p, None, kind, dt, None) for at, (p, _, kind, dt) in enumerate(extra.get(e.alt_label, ()), 1)]
    table = df.sparkSession.createDataFrame(said, "ordinal int, at int, p string, o string, o_kind string, o_dt string, o_lang string")
    at = F.col("at")
    o = F.when(at == _SAME, F.col("o")).when(at == _KEY, F.col("_key_")).when(at == _LICENSE, S.license_iri(F.lit(license).cast("string"), licenses)).otherwise(F.get("own", at))
    return rows.join(F.broadcast(table), "ordinal").withColumn("o", o).where("o is not null").select(*TRIPLE_COLUMNS)


def merged(triples: DataFrame) -> DataFrame:
    """The set of triples over all graphs; g is null."""
    return triples.select(*TRIPLE_COLUMNS[1:]).distinct().select(F.lit(None).cast("string").alias("g"), *TRIPLE_COLUMNS[1:])


def firewall(triples: DataFrame, classes: DataFrame, class_column: str = "iri") -> DataFrame:
    """triples in which a subject with any type outside classes has the plain entity as its only type. For triples from
    elsewhere; table_triples settles its own from the template. classes is an ontology's, checked before a broadcast."""
    is_type = F.col("p") == f"{RDF}type"
    known = small(classes.select(F.col(class_column).alias("o"), F.lit(True).alias("known")).distinct())
    types = triples.where(is_type)
    bad = types.join(known, "o", "left").groupBy("g", "s").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("ok"))
    same = types.alias("a").join(bad.alias("b"), F.expr("a.g <=> b.g and a.s = b.s"))
    fine = same.where("ok").select("a.*")
    plain = bad.where("not ok").select("g", "s", F.lit(f"{RDF}type").alias("p"), F.lit(ENTITY_IRI).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    return triples.where(~is_type).select(*TRIPLE_COLUMNS).unionByName(fine.select(*TRIPLE_COLUMNS)).unionByName(plain)


def license_triple(spark, license: str | None, base: str = HOME, licenses: Sequence[str] | None = None) -> DataFrame:
    """The dataset's licence as one triple; no row where no licence is given."""
    rows = spark.createDataFrame([(license,)] if license else [], "l string")
    return emit(rows, None, [triple(F.lit(f"{base}Dataset"), f"{DCT}license", S.license_iri("l", licenses), "iri")])
