"""Metadata templates: what each column means, its unit and stage.

A template is a DataFrame (ordinal, alt_label, type, definition, unit, stage, note); matching columns with an ontology
is an equi-join on normalised names first, and a similarity search for what is left over.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom import functions as S
from semloom.operators.serialize import Entry
from semloom.session import small
from semloom.terms import GENERIC_TYPE, HELPERS, NO_DEFINITION, PREFIXES, UNITLESS

COLUMNS = "ordinal int, alt_label string, type string, definition string, unit string, stage string, note string"
NO_STAGE = ("", "Study stage information not available")
CUTOFF = 0.8


def frame(spark: SparkSession, entries: Sequence[Entry]) -> DataFrame:
    return spark.createDataFrame([(i, e.alt_label, e.type, e.definition, e.unit, e.stage, e.note) for i, e in enumerate(entries)], COLUMNS)


def entries(template: DataFrame) -> list[Entry]:
    """The template on the driver: a row a column."""
    rows = template.orderBy("ordinal", "alt_label").collect()
    return [Entry(r["alt_label"], r["type"], r["definition"], r["unit"], r["stage"], r["note"]) for r in rows]


# --- matching


def exact_matches(labels: DataFrame, terms: DataFrame, column: str = "label", term: str = "label") -> DataFrame:
    """(column, iri, term): labels whose normalised name is a term's; of several terms the one that sorts first."""
    a = labels.select(F.col(column).alias("column")).distinct().withColumn("key", S.normalize("column"))
    b = terms.select("iri", F.col(term).alias("term")).withColumn("key", S.normalize("term")).groupBy("key").agg(F.min(F.struct("iri", "term")).alias("t"))
    return a.join(small(b), "key").select("column", "t.iri", "t.term")


def unmatched(labels: DataFrame, matches: DataFrame, column: str = "label") -> DataFrame:
    return labels.select(F.col(column).alias("column")).distinct().join(matches.select("column"), "column", "left_anti")


def best_ratio(keys: Sequence[str], terms: Sequence[str], cutoff: float = CUTOFF) -> list[tuple[str | None, float | None]]:
    """The most similar term of each key by matching blocks, at the cutoff at least; of equal ones the last by name.
    Two bounds that cost next to nothing come before the exact ratio."""
    out, matcher = [], SequenceMatcher()
    ordered = sorted(set(terms))
    for key in keys:
        best: tuple[float, str] | None = None
        matcher.set_seq2(key)
        for t in ordered:
            floor = max(cutoff, best[0]) if best else cutoff
            total = len(t) + len(key)
            if total and 2 * min(len(t), len(key)) / total < floor:
                continue
            matcher.set_seq1(t)
            if matcher.quick_ratio() < floor:
                continue
            r = matcher.ratio()
            if r >= cutoff and (best is None or (r, t) >= best):
                best = (r, t)
        out.append((best[1], best[0]) if best else (None, None))
    return out


#: Terms that similar names are looked for in.
MOST_TERMS = 1_000_000


def fuzzy_matches(labels: DataFrame, terms: DataFrame, column: str = "label", term: str = "label", cutoff: float = CUTOFF) -> DataFrame:
    """(column, iri, term, ratio) of the distinct labels that a term is similar to. The terms are an ontology's labels, at
    most MOST_TERMS (about 100 bytes each), and go to every task; more are an error. The labels are column names, however
    many tables they come from, and stay distributed."""
    a = labels.select(F.col(column).alias("column")).distinct().withColumn("key", S.normalize("column"))
    rows = terms.select("iri", F.col(term).alias("term")).withColumn("key", S.normalize("term")).groupBy("key").agg(F.min(F.struct("iri", "term")).alias("t")).select("key", "t.iri", "t.term").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms to compare with")
    names = labels.sparkSession.sparkContext.broadcast({r["key"]: (r["iri"], r["term"]) for r in rows})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = names.value
        for f in frames:
            found = best_ratio(f["key"].tolist(), list(by), cutoff)
            got = [(c, *by[t], r) for c, (t, r) in zip(f["column"], found, strict=True) if t is not None]
            yield pd.DataFrame(got, columns=["column", "iri", "term", "ratio"])

    return a.mapInPandas(run, "column string, iri string, term string, ratio double")


def match(labels: DataFrame, terms: DataFrame, column: str = "label") -> DataFrame:
    """(column, iri, term, ratio): exact matches (ratio 1), then similar ones for the rest."""
    exact = exact_matches(labels, terms, column)
    rest = unmatched(labels, exact, column)
    return exact.withColumn("ratio", F.lit(1.0)).unionByName(fuzzy_matches(rest, terms, "column"))


# --- units


def unit_token(cell: Column | str) -> Column:
    """What a unit cell names: the rest of a prefix:rest, whether bare or as the @id of a dict literal; else the cell."""
    c = F.trim(F.col(cell) if isinstance(cell, str) else cell)
    inner = F.when(c.startswith("{") & c.endswith("}"), F.regexp_extract(c, r"""['"]@id['"]\s*:\s*['"]([^'"]*)['"]""", 1)).otherwise(c)
    return F.when(inner.contains(":"), F.element_at(F.split(inner, ":"), 2)).otherwise(inner)


def unit_lookup(cells: DataFrame, known: DataFrame, cell: str = "unit") -> DataFrame:
    """(cell, unit, candidates): the unit that each distinct cell means. A prefixed cell is taken as it is; another one
    is looked up by name or label (whatever the case) and by UCUM code; if none or more than one is found: UNITLESS."""
    c = cells.select(F.col(cell).alias("cell")).where("cell is not null").distinct()
    c = c.withColumn("token", unit_token("cell")).withColumn("given", F.col("cell").contains(":"))
    keys = known.select("name", F.explode(F.filter(F.array(F.struct(F.lit("ci").alias("kind"), F.lower("name").alias("key")), F.struct(F.lit("ci").alias("kind"), F.lower("label").alias("key")), F.struct(F.lit("cs").alias("kind"), F.col("ucum_code").alias("key"))), lambda x: x.key.isNotNull() & (x.key != ""))).alias("k")).select("name", "k.*").distinct()
    ask = c.where(~F.col("given")).select("cell", F.explode(F.array(F.struct(F.lit("ci").alias("kind"), F.lower("token").alias("key")), F.struct(F.lit("cs").alias("kind"), F.col("token").alias("key")))).alias("k")).select("cell", "k.*")
    found = ask.join(small(keys), ["kind", "key"]).groupBy("cell").agg(F.array_sort(F.collect_set("name")).alias("candidates"))
    out = c.join(found, "cell", "left")
    unit = F.when(F.col("given"), F.when(F.col("token") != "", F.col("token")).otherwise(UNITLESS)).when(F.size("candidates") == 1, F.col("candidates")[0]).otherwise(UNITLESS)
    return out.select("cell", unit.alias("unit"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


# --- generation


def generate(header: DataFrame, terms: DataFrame, known_units: DataFrame, home_prefix: str = "home", bindings: Mapping[str, str] = PREFIXES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(template, matched log, unmatched log) of header (ordinal, column, type, unit, stage), a row a column.

    A type given as prefix:rest is kept; another column takes the type of the best matching term, else its normalised
    name under the home prefix. Definition and stage come from the term; a column whose type is given in another
    vocabulary takes the header's stage. Units are looked up (see unit_lookup). Helper columns are left out."""
    h = header.where(~F.col("column").isin(*HELPERS))
    found = match(h, terms, "column").withColumnRenamed("ratio", "_ratio")
    facts = terms.groupBy("iri").agg(F.min(F.struct("definition", "stage")).alias("f")).select("iri", "f.definition", F.col("f.stage").alias("term_stage"))
    unit = unit_lookup(h, known_units).select(F.col("cell").alias("unit"), F.col("unit").alias("_unit"))
    j = h.join(found, "column", "left").join(small(facts), "iri", "left").join(small(unit), "unit", "left")
    given = F.coalesce(F.col("type").contains(":"), F.lit(False))
    own = F.substring_index("type", ":", 1) == home_prefix
    names = {p: ns for p, ns in bindings.items() if p != home_prefix}
    rest = F.concat(F.lit(f"{home_prefix}:"), F.when(F.col("iri").isNotNull(), S.fragment("iri")).otherwise(S.normalize("column")))
    by_term = F.when(F.col("iri").isNotNull(), S.curie("iri", names, "")).otherwise("")
    type_ = F.when(given, F.col("type")).when(by_term != "", by_term).otherwise(rest)
    from_term = ~given | own
    definition = F.when(from_term & F.col("iri").isNotNull(), F.col("definition")).otherwise(NO_DEFINITION)
    stage = F.when(from_term, F.col("term_stage")).otherwise(F.col("stage"))
    stage = F.when(stage.isNull() | stage.isin(*NO_STAGE), "").otherwise(stage)
    out = j.select("ordinal", F.col("column").alias("alt_label"), type_.alias("type"), definition.alias("definition"), F.coalesce("_unit", F.lit(UNITLESS)).alias("unit"), stage.alias("stage"), F.lit("").alias("note"))
    log = j.where("iri is not null").select(F.concat("column", F.lit(" => "), S.fragment(F.when(given, F.regexp_replace("type", "^[^:]*:", "")).otherwise(F.col("iri")))).alias("line"))
    return out, log, j.where("iri is null").select(F.col("column").alias("line")).distinct()


# --- changes


FIELDS = ("definition", "unit", "type", "stage", "note")


def update(template: DataFrame, column: str, field: str, value: str) -> DataFrame:
    if field not in FIELDS:
        raise ValueError(f"{field} is no field of a template; those are {', '.join(FIELDS)}")
    return template.withColumn(field, F.when(F.col("alt_label") == column, F.lit(value)).otherwise(F.col(field)))


def upsert(template: DataFrame, changes: DataFrame) -> DataFrame:
    """template with changes (alt_label and any of FIELDS) merged in by label: fields that aren't null or empty replace
    the old ones, new labels are added after all others with defaults. A label that changes repeats counts once, its
    greatest row."""
    for f in FIELDS:
        if f not in changes.columns:
            changes = changes.withColumn(f, F.lit(None).cast("string"))
    new = changes.where("alt_label is not null").groupBy("alt_label").agg(F.max(F.struct(*FIELDS)).alias("n"))
    end = template.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("end"))
    default = {"definition": NO_DEFINITION, "unit": UNITLESS, "type": GENERIC_TYPE, "stage": "UNK", "note": ""}
    both = template.alias("t").join(new.alias("c"), F.expr("t.alt_label = c.alt_label"), "full").crossJoin(F.broadcast(end))
    fresh = F.col("t.alt_label").isNull()
    value = lambda f: F.coalesce(F.when(F.col(f"c.n.{f}") != "", F.col(f"c.n.{f}")), F.when(fresh, F.lit(default[f])).otherwise(F.col(f"t.{f}")))
    return both.select(F.coalesce("t.ordinal", F.col("end") + 1).cast("int").alias("ordinal"), F.coalesce("t.alt_label", "c.alt_label").alias("alt_label"), *[value(f).alias(f) for f in ("type", "definition", "unit", "stage", "note")])


def add_column(template: DataFrame, column: str, type_: str, unit: str = UNITLESS, definition: str = NO_DEFINITION, stage: str = "UNKNOWN") -> tuple[DataFrame, bool]:
    """(template, whether the column was new); one that is there already stays as it is."""
    if not template.where(F.col("alt_label") == column).isEmpty():
        return template, False
    at = template.agg(F.max("ordinal").alias("m")).first()["m"]
    row = template.sparkSession.createDataFrame([(0 if at is None else at + 1, column, type_, definition, unit, stage, "")], COLUMNS)
    return template.unionByName(row), True


def delete_column(template: DataFrame, column: str) -> DataFrame:
    return template.where(F.col("alt_label") != column)


def audit(template: DataFrame, columns: DataFrame) -> DataFrame:
    """(check, label, detail): columns (column) without an entry, entries without a column, entries that lack a type or
    a definition. Helper columns count for nothing."""
    c = columns.select(F.col("column").alias("label")).where(~F.col("label").isin(*HELPERS)).distinct()
    t = template.withColumnRenamed("alt_label", "label")
    undefined = c.join(t.select("label"), "label", "left_anti").select(F.lit("undefined_column").alias("check"), "label", F.lit("").alias("detail"))
    empty = t.join(c, "label", "left_anti").select(F.lit("empty_entry").alias("check"), "label", F.lit("").alias("detail"))
    lacks = F.filter(F.array(F.when(F.coalesce("type", F.lit("")) == "", "type"), F.when((F.coalesce("definition", F.lit("")) == "") | F.lower("definition").contains("not available"), "definition")), lambda x: x.isNotNull())
    missing = t.select(F.lit("missing_field").alias("check"), "label", F.explode(lacks).alias("detail"))
    return undefined.union(empty).union(missing)


def aligned(issues: DataFrame) -> bool:
    """Whether an audit has nothing but entries without a column."""
    return issues.where("check <> 'empty_entry'").isEmpty()


def view(template: DataFrame) -> DataFrame:
    """(column, type, unit, definition, stage) for reading; long definitions cut."""
    return template.select(F.col("alt_label").alias("column"), "type", "unit", S.shorten("definition", 50).alias("definition"), "stage")


# --- JSON-LD form


def to_jsonld(rows: Sequence[Entry], bindings: Mapping[str, str] = PREFIXES, home_prefix: str = "home") -> dict:
    """The template as a JSON-LD document: a node a column."""
    graph = []
    for e in rows:
        node = {"@id": e.id or e.type, "@type": e.type, "skos:altLabel": e.alt_label, "skos:definition": e.definition or NO_DEFINITION, "qudt:hasUnit": dict([("@id", "unit:" + (e.unit or UNITLESS))]), "skos:note": {"@value": e.note or "", "@language": e.note_lang or "en"}, f"{home_prefix}:hasStudyStage": e.stage or ""}
        if e.generated_at:
            node["prov:generatedAtTime"] = {"@value": e.generated_at, "@type": "xsd:dateTime"}
        graph.append(node)
    return {"@context": dict(sorted(bindings.items())), "@graph": graph}


def from_jsonld(doc: dict | list, stage_key: str = "hasStudyStage") -> list[Entry]:
    """The entries of a template document: {"@graph": [...]}, a list of nodes or a single node."""
    nodes = doc.get("@graph", [doc] if "@type" in doc or "skos:altLabel" in doc else []) if isinstance(doc, dict) else doc
    nodes = [nodes] if isinstance(nodes, dict) else nodes
    out = []
    for n in nodes:
        text = lambda v, k: (v.get(k, "") if isinstance(v, dict) else v) or ""
        first = lambda v: v[0] if isinstance(v, list) and v else v
        stage = next((v for k, v in n.items() if k.split(":")[-1] == stage_key), "")
        unit = text(first(n.get("qudt:hasUnit")), "@id").split(":")[-1].rsplit("/", 1)[-1]
        note = first(n.get("skos:note"))
        at = first(n.get("prov:generatedAtTime"))
        out.append(Entry(text(first(n.get("skos:altLabel")), "@value"), str(first(n.get("@type", ""))), text(first(n.get("skos:definition")), "@value") or NO_DEFINITION, unit or None, text(first(stage), "@value"), text(note, "@value"), note.get("@language", "en") if isinstance(note, dict) else "en", text(at, "@value") or None, n.get("@id")))
    return out
