"""Data cubes: tables to data sets of slices and observations, and back.

A cube is kept in long form as far as possible: slices are a projection of the rows, observations an unpivot of the
measures, and the structure definition a handful of rows. Three layouts: "entire" (one data set, a slice a row), "rows"
(a data set a row) and "flat" (value, unit and type of each variable under a salted name).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semloom import functions as S
from semloom.operators.serialize import datatype_of, emit, triple
from semloom.session import numbered, small, spread
from semloom.terms import CUBE_PREFIXES, DCT, HOME, NO_ORCID, QB, QUDT, RDF, SDMX, SKOS, TRIPLE_COLUMNS, XSD

EXPERIMENT = "ExperimentId"
UNIT_MEASURE = f"{SDMX}attribute#unitMeasure"


class Variable(NamedTuple):
    name: str
    is_measure: bool = False
    alt_label: str | None = None
    category: str | None = None
    unit: str | None = None
    existing: str | None = None


def namespaces(given: Mapping[str, str], user_prefix: str, defaults: Mapping[str, str] = CUBE_PREFIXES) -> tuple[dict[str, str], str]:
    """(all prefixes, the user's namespace). IRIs must be http(s); one that ends in neither "/" nor "#" gets a "#"."""
    out = dict(defaults)
    for p, iri in given.items():
        iri = iri.strip()
        if not iri.startswith(("http://", "https://")):
            raise ValueError(f"the namespace of {p!r} is no http IRI: {iri!r}")
        out[p.strip().lower()] = iri if iri.endswith(("/", "#")) else f"{iri}#"
    if user_prefix not in out:
        raise ValueError(f"prefix {user_prefix!r} isn't bound")
    return out, out[user_prefix]


def split_variables(variables: Sequence[Variable], columns: Sequence[str]) -> tuple[list[Variable], list[Variable], list[str]]:
    """(dimensions, measures, columns that no variable describes). The experiment's id is always a dimension, first
    unless described elsewhere."""
    by = {v.name: v for v in variables}
    known = [by[c] for c in columns if c in by]
    dims = [v for v in known if not v.is_measure]
    if EXPERIMENT in columns and EXPERIMENT not in by:
        dims.insert(0, Variable(EXPERIMENT))
    return dims, [v for v in known if v.is_measure], [c for c in columns if c not in by and c != EXPERIMENT]


def id_candidates(columns: Sequence[str]) -> list[str]:
    """Columns whose name has "id" in it, whatever the case; for the caller to choose from."""
    return [c for c in columns if "id" in c.lower()]


def property_of(v: Variable, ns: str, bindings: Mapping[str, str]) -> str:
    e = (v.existing or "").strip()
    if not e:
        return ns + v.name.replace(" ", "_")
    if "://" in e:
        return e
    prefix, _, rest = e.partition(":")
    if prefix not in bindings:
        raise ValueError(f"unknown prefix in {e!r}")
    return bindings[prefix] + rest


def unit_of(v: Variable, ns: str, bindings: Mapping[str, str]) -> str | None:
    u = (v.unit or "").strip().replace(" ", "_")
    if not u or "://" in u:
        return u or None
    prefix, colon, rest = u.partition(":")
    return (bindings[prefix] + rest if prefix in bindings else None) if colon else ns + u


def structure(spark, dims: Sequence[Variable], measures: Sequence[Variable], ns: str, bindings: Mapping[str, str]) -> DataFrame:
    """Triples of the structure definition. Components are blank nodes named by what they hold, so equal cubes have
    equal triples."""
    dsd, rows = f"{ns}DataStructureDefinition", []

    def lit(s, p, o):
        rows.append((None, s, p, o, "lit", None, None))

    def iri(s, p, o):
        rows.append((None, s, p, o, "bnode" if o.startswith("_:") else "iri", None, None))

    def component(kind: str, prop: str) -> None:
        node = "_:component_" + kind + "_" + "".join(c if c.isalnum() else "_" for c in prop)
        iri(dsd, f"{QB}component", node)
        iri(node, f"{QB}{kind}", prop)
        iri(prop, f"{RDF}type", f"{QB}{kind.capitalize()}Property")

    iri(dsd, f"{RDF}type", f"{QB}DataStructureDefinition")
    component("dimension", f"{QB}measureType")
    for kind, group in (("dimension", dims), ("measure", measures)):
        for v in group:
            p = property_of(v, ns, bindings)
            component(kind, p)
            if v.alt_label:
                lit(p, f"{SKOS}altLabel", v.alt_label)
            if v.category:
                iri(p, f"{ns}category", ns + v.category.replace(" ", "_"))
    every = [*dims, *measures]
    if any(v.unit for v in every):
        component("attribute", UNIT_MEASURE)
    if any(v.category for v in every):
        component("attribute", f"{ns}category")
    return spark.createDataFrame(rows, "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string").distinct()


def row_name(id_columns: Sequence[str], orcid: str, stamp: str, clean=S.sanitize_iri, sep: str = "_") -> Column:
    """A row's name of its id columns ("NotFound" for null), the curator's digits and the time of the run."""
    digits = "".join(c for c in orcid if c.isdigit())
    parts = [clean(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NotFound"))) for c in id_columns]
    tail = [F.lit(digits), F.lit(stamp)]
    whole = F.concat_ws(sep, *parts, *tail)
    if parts:
        empty = F.concat_ws("", *parts) == ""
        whole = F.when(empty, F.lit(f"{digits}_{stamp}")).otherwise(whole)
    return clean(whole) if sep == "_" else whole


def measure_value(value: Column) -> tuple[Column, Column]:
    """(text, datatype): a double where the value reads as a number, else a plain literal."""
    number = value.cast("string").try_cast("double")
    return F.when(number.isNotNull(), number.cast("string")).otherwise(value.cast("string")), F.when(number.isNotNull(), F.lit(f"{XSD}double"))


def observations(df: DataFrame, measures: Sequence[Variable], keep: Sequence[str]) -> DataFrame:
    """(.. keep, measure, ordinal, value, datatype): one row a measure that isn't null, by one unpivot."""
    cells = []
    for i, m in enumerate(measures):
        text, dt = measure_value(F.col(f"`{m.name}`"))
        cells.append(F.struct(F.lit(m.name).alias("measure"), F.lit(i).alias("ordinal"), text.alias("value"), dt.alias("datatype")))
    return df.select(*keep, F.explode(F.filter(F.array(*cells), lambda x: x.value.isNotNull())).alias("o")).select(*keep, "o.*")


def numbered_observations(obs: DataFrame, row: str) -> DataFrame:
    """observations() with observation: 1, 2, ... over all rows by (row, ordinal). A total order over the whole cube: it
    costs a range partitioning, where numbers within a slice cost nothing."""
    return numbered(obs, [row, "ordinal"], "observation")


def dimension_triples(df: DataFrame, node: Column, dims: Sequence[Variable], ns: str, bindings: Mapping[str, str]) -> list[Column]:
    """One triple a dimension: its value as a native literal, or the NotFound node where it is null."""
    out = []
    for v in dims:
        kind, c = df.schema[v.name].dataType, F.col(f"`{v.name}`")
        text = S.iso_instant(c) if isinstance(kind, T.TimestampType) else c.cast("string")
        gone = c.isNull()
        out.append(triple(node, property_of(v, ns, bindings), F.when(gone, F.lit(f"{ns}NotFound")).otherwise(text), F.when(gone, "iri").otherwise("lit"), F.when(~gone, F.lit(datatype_of(kind)).cast("string"))))
    return out


def cube_triples(
    df: DataFrame,
    variables: Sequence[Variable],
    *,
    mode: str = "entire",
    name: str = "dataset",
    id_columns: Sequence[str] = (),
    orcid: str = NO_ORCID,
    stamp: str = "00000000000000",
    fixed: Sequence[str] | None = None,
    given: Mapping[str, str] | None = None,
    user_prefix: str = "home",
    row: str | None = None,
    global_numbers: bool = False,
) -> DataFrame:
    """Triples of the cube of df. g is the data set: one in mode "entire", one a row in "rows" and "flat".

    Dimensions in `fixed` (default: all) are said of the slice, others of each observation. Rows whose names are equal
    share a slice unless `row`, a unique column, tells them apart. Observations are numbered within their slice, whose
    name they carry; global_numbers asks for one count over the whole cube, by `row`."""
    bindings, ns = namespaces(given or {}, user_prefix)
    dims, measures, _ = split_variables(variables, df.columns)
    spark = df.sparkSession
    if mode == "flat":
        return _flat(df, variables, id_columns, orcid, stamp, ns, bindings)
    if mode not in ("entire", "rows"):
        raise ValueError(f"unknown mode {mode!r}")
    if global_numbers and row is None:
        raise ValueError("global numbers need a unique row column")
    own = row_name(id_columns, orcid, stamp)
    if row:
        own = F.concat(own, F.lit("_"), F.col(row).cast("string"))
    rows = spread(df).withColumn("_name_", own)
    n = F.col("_name_")
    single = mode == "entire"
    dataset_id = S.sanitize_iri(F.lit(f"Dataset_{name}")) if single else F.concat(F.lit("Dataset_"), n)
    key_id = S.sanitize_iri(F.lit(f"SliceKey_{name}")) if single else F.concat(F.lit("SliceKey_"), n)
    dataset, key, slice_ = F.concat(F.lit(ns), dataset_id), F.concat(F.lit(ns), key_id), F.concat(F.lit(f"{ns}Slice_"), n)
    fixed_dims = [d for d in dims if fixed is None or d.name in fixed]
    free_dims = [d for d in dims if d not in fixed_dims]
    dsd = f"{ns}DataStructureDefinition"

    about = [
        triple(dataset, f"{RDF}type", f"{QB}DataSet", "iri"),
        triple(dataset, f"{QB}structure", dsd, "iri"),
        triple(dataset, f"{DCT}title", F.lit(name) if single else dataset_id),
        triple(dataset, f"{DCT}creator", orcid),
        triple(key, f"{RDF}type", f"{QB}SliceKey", "iri"),
        *[triple(key, f"{QB}componentProperty", property_of(d, ns, bindings), "iri") for d in fixed_dims],
    ]
    sliced = [
        triple(slice_, f"{RDF}type", f"{QB}Slice", "iri"),
        triple(slice_, f"{QB}sliceStructure", key, "iri"),
        triple(dataset, f"{QB}slice", slice_, "iri"),
        *dimension_triples(df, slice_, fixed_dims, ns, bindings),
    ]
    head = spark.range(1)
    what = structure(spark, dims, measures, ns, bindings)
    parts = [emit(head if single else rows, dataset, about), emit(rows, dataset, sliced)]
    # the definition is the same for all data sets: in row mode it belongs to no graph instead of to every one
    parts.append(what.withColumn("g", dataset) if single else what)

    if measures:
        keep = ["_name_", *[f"`{d.name}`" for d in free_dims], *([row] if global_numbers else [])]
        obs = observations(rows, measures, keep)
        if global_numbers:
            obs = numbered_observations(obs, row)
            node = F.concat(F.lit(f"{ns}observation_"), F.col("observation").cast("string"))
        else:
            node = F.concat(F.lit(f"{ns}observation_"), n, F.lit("_"), (F.col("ordinal") + 1).cast("string"))
        said = spark.createDataFrame([(i, property_of(m, ns, bindings), unit_of(m, ns, bindings)) for i, m in enumerate(measures)], "ordinal int, prop string, unit string")
        obs = obs.join(F.broadcast(said), "ordinal")
        each = [
            triple(slice_, f"{QB}observation", node, "iri"),
            triple(node, f"{RDF}type", f"{QB}Observation", "iri"),
            triple(node, f"{QB}measureType", F.col("prop"), "iri"),
            triple(node, F.col("prop"), F.col("value"), "lit", F.col("datatype")),
            triple(node, UNIT_MEASURE, F.col("unit"), "iri"),
            *dimension_triples(df, node, free_dims, ns, bindings),
        ]
        parts.append(emit(obs, dataset, each))
    out = parts[0].select(*TRIPLE_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*TRIPLE_COLUMNS))
    return out


def _flat(df: DataFrame, variables: Sequence[Variable], id_columns, orcid: str, stamp: str, ns: str, bindings: Mapping[str, str]) -> DataFrame:
    """The flat layout: a node a variable and row, named variable-salt-ids; a float where the variable has a unit (a
    blank node stands for a unit that isn't known), else a string."""
    name = row_name(id_columns, orcid, stamp, S.sanitize_filename, "-")
    rows = df.withColumn("_name_", F.concat_ws("-", S.salt_letter(name), name))
    out = []
    for v in variables:
        if v.name not in df.columns:
            continue
        prop, unit, c = property_of(v, ns, bindings), unit_of(v, ns, bindings), F.col(f"`{v.name}`").cast("string")
        node = F.when(c.isNotNull(), F.concat(F.lit(f"{prop}-"), F.col("_name_")))
        blank = F.concat(F.lit("_:u"), F.substring(F.sha2(node, 256), 1, 16))
        out += [
            triple(node, f"{RDF}type", prop, "iri"),
            triple(node, f"{QUDT}hasUnit", F.lit(unit) if unit else blank, "iri" if unit else "bnode"),
            triple(node, f"{QUDT}value", c, "lit", f"{XSD}float" if unit else None),
        ]
    return emit(rows, F.concat(F.lit(ns), F.col("_name_")), out).select(*TRIPLE_COLUMNS)


# --- back to a table


def read_variables(triples: DataFrame, category: str = f"{HOME}category") -> DataFrame:
    """(name, is_measure, alt_label, category, units, existing) of a cube's structure definitions; the measure type is
    no variable. Definitions of several data sets merge: units as a sorted set, the first label and category by name, a
    measure if any says so."""
    comp = triples.where(F.col("p") == f"{QB}component").select(F.col("o").alias("node")).distinct()
    prop = triples.where(F.col("p").isin(f"{QB}dimension", f"{QB}measure")).select(F.col("s").alias("node"), F.col("o").alias("prop"), (F.col("p") == f"{QB}measure").alias("is_measure"))
    v = prop.join(comp, "node", "left_semi").where(F.col("prop") != f"{QB}measureType").groupBy("prop").agg(F.bool_or("is_measure").alias("is_measure"))
    of = lambda p, n: triples.where(F.col("p") == p).groupBy(F.col("s").alias("prop")).agg(F.min("o").alias(n))
    # an observation's measures and units meet in one aggregation, most of it before the shuffle
    both = lambda p, n: F.collect_set(F.when(F.col("p") == p, F.col("o"))).alias(n)
    obs = triples.where(F.col("p").isin(f"{QB}measureType", UNIT_MEASURE)).groupBy("s").agg(both(f"{QB}measureType", "props"), both(UNIT_MEASURE, "units"))
    units = obs.select(F.explode("props").alias("prop"), "units").select("prop", F.explode("units").alias("unit")).groupBy("prop").agg(F.array_sort(F.collect_set("unit")).alias("units"))
    out = v.join(of(f"{SKOS}altLabel", "alt_label"), "prop", "left").join(of(category, "cat"), "prop", "left").join(units, "prop", "left")
    rows = out.select(S.fragment("prop").alias("name"), "is_measure", "alt_label", S.fragment("cat").alias("category"), F.coalesce("units", F.array().cast("array<string>")).alias("units"), F.col("prop").alias("existing"))
    return merge_variables(rows)


def merge_variables(rows: DataFrame) -> DataFrame:
    """One row a name of rows (name, is_measure, alt_label, category, units, existing)."""
    first = lambda c: F.min(F.when(F.trim(c) != "", F.col(c))).alias(c)
    return rows.groupBy("name").agg(F.bool_or("is_measure").alias("is_measure"), first("alt_label"), first("category"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("units")))).alias("units"), first("existing"))


def cube_table(triples: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """The wide table of a cube's triples: dimensions, then measures; a row for each tuple of dimensions, over all data
    sets. A measure that comes twice for a tuple takes the observation that sorts last; NotFound reads as null, a tuple
    without any measure has no row. All columns are text but measures of numbers, which are doubles. Rows go by
    ExperimentId, where there is one: by its number, ones that are none last and by text."""
    described = (read_variables(triples) if variables is None else variables).orderBy("name").collect()
    dims = [(r["name"], r["existing"]) for r in described if not r["is_measure"]]
    measures = {r["existing"]: r["name"] for r in described if r["is_measure"]}
    dims.sort(key=lambda d: (d[0] != EXPERIMENT, d[0]))

    value = lambda p: F.min(F.when(F.col("p") == p, F.when(~((F.col("o_kind") == "iri") & F.col("o").endswith("NotFound")), F.col("o"))))
    # all that is said of a node, an observation's links among it, meets in one aggregation
    p, linked, typed = F.col("p"), F.col("p") == f"{QB}observation", F.col("p") == f"{QB}measureType"
    some = triples.where(p.isin(*[p for _, p in dims], *measures, f"{QB}sliceStructure", f"{QB}measureType", f"{QB}observation"))
    about = F.when(linked, F.col("o")).otherwise(F.col("s")).alias("node")
    facts = some.groupBy(about).agg(
        F.max(F.when(~linked, typed.cast("int"))).alias("is_obs"),
        F.min(F.when(typed, F.col("o"))).alias("kind"),
        F.collect_set(F.when(linked, F.col("s"))).alias("slices"),
        *[value(p).alias(f"d{i}") for i, (_, p) in enumerate(dims)],
        *[F.max(F.when(F.col("p") == p, F.col("o"))).alias(f"m{i}") for i, p in enumerate(measures)],
    )
    own = F.coalesce(*[F.when(F.col("kind") == p, F.col(f"m{i}")) for i, p in enumerate(measures)], F.lit(None).cast("string"))
    obs = facts.where("is_obs = 1").select(F.col("node").alias("obs"), "kind", own.alias("value"), *[f"d{i}" for i in range(len(dims))], F.explode("slices").alias("slice")).where("value is not null")
    slices = facts.where("is_obs = 0").select(F.col("node").alias("slice"), *[F.col(f"d{i}").alias(f"e{i}") for i in range(len(dims))])
    j = obs.join(slices, "slice", "left")
    keys = [F.coalesce(f"d{i}", f"e{i}").alias(n) for i, (n, _) in enumerate(dims)]
    long = j.select(*keys, F.col("kind").alias("_kind_"), F.col("obs").alias("_obs_"), F.col("value").alias("_value_"))
    last = lambda p: F.max_by("_value_", F.when(F.col("_kind_") == p, F.struct(F.length("_obs_"), "_obs_")))
    named = sorted((n, p) for p, n in measures.items()) or [("_none_", None)]
    out = long.groupBy(*[F.col(f"`{n}`") for n, _ in dims]).agg(*[last(p).alias(n) for n, p in named])
    # one more read of the measures' values alone tells which are numbers throughout
    kinds = triples.where(F.col("p").isin(*measures) & (F.col("o_kind") == "lit")).groupBy("p").agg(F.bool_and(F.coalesce(F.col("o_dt") == f"{XSD}double", F.lit(False))).alias("number")) if measures else None
    for r in kinds.where("number").collect() if measures else ():
        out = out.withColumn(measures[r["p"]], F.col(f"`{measures[r['p']]}`").cast("double"))
    if EXPERIMENT in out.columns:
        out = out.orderBy(F.expr(f"try_cast({EXPERIMENT} as double)").asc_nulls_last(), EXPERIMENT)
    return out


def stats(table: DataFrame, variables: DataFrame) -> dict:
    """Rows, columns and distinct categories."""
    return {"rows": table.count(), "columns": len(table.columns), "categories": [r[0] for r in variables.select("category").where("category is not null").distinct().orderBy("category").collect()]}


def fill_experiment_ids(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df with ExperimentId 1, 2, ... by the order if it lacks the column or has any null in it; else as it is."""
    if EXPERIMENT in df.columns:
        if df.where(F.col(EXPERIMENT).isNull()).isEmpty():
            return df
        df = df.drop(EXPERIMENT)
    return numbered(df, list(order), EXPERIMENT)


def observations_of(triples: DataFrame) -> DataFrame:
    """(g, slice, obs, measure, value, datatype, unit): a cube's triples in long form."""
    kind = triples.where(F.col("p") == f"{QB}measureType").select("g", F.col("s").alias("obs"), F.col("o").alias("measure"))
    value = triples.where("o_kind = 'lit'").select("g", F.col("s").alias("obs"), F.col("p").alias("measure"), F.col("o").alias("value"), F.col("o_dt").alias("datatype"))
    unit = triples.where(F.col("p") == UNIT_MEASURE).select("g", F.col("s").alias("obs"), F.col("o").alias("unit"))
    link = triples.where(F.col("p") == f"{QB}observation").select("g", F.col("s").alias("slice"), F.col("o").alias("obs"))
    return link.join(kind, ["g", "obs"]).join(value, ["g", "obs", "measure"]).join(unit, ["g", "obs"], "left").select("g", "slice", "obs", "measure", "value", "datatype", "unit")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "small")]
