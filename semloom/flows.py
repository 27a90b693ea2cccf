"""The cube's ways from end to end: an ontology to workbooks that people fill in, and those to linked data and tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from semloom.operators import cube, ontology
from semloom.operators.cube import Variable
from semloom.sources import rdf, tables
from semloom.terms import CUBE_PREFIXES, NO_ORCID, PREFIXES


class Templates(NamedTuple):
    namespaces: str
    data: str
    variables: list[Variable]
    unmapped: list[str]  # terms of the ontology without a category


def experiment(spark: SparkSession, out: str, low: DataFrame | None = None, combined: DataFrame | None = None, namespace: str = "", bindings: Mapping[str, str] = PREFIXES, prefixes: Mapping[str, str] = CUBE_PREFIXES) -> Templates:
    """The workbooks of a new experiment in the folder `out` of this machine: one of namespaces and one of data, with a
    column for each lowest term of `low` under its category in `combined`, columns of a category side by side.

    Without ontologies the data workbook has no columns yet. The terms are an ontology's leaves, which a person reads; they
    come to the driver."""
    rows = [] if low is None or combined is None else ontology.classification(low, combined, namespace, bindings).collect()
    local = lambda name: name.rsplit(":", 1)[-1].rsplit("/", 1)[-1].rsplit("#", 1)[-1]
    found = sorted((local(r["category"]), local(r["term"]), r["term"]) for r in rows if r["category"])
    variables = [Variable(name, category=category, existing=term) for category, name, term in found]
    fs, folder = rdf.store(out)
    fs.create_dir(folder, recursive=True)
    made = Templates(f"{folder}/namespace_template.xlsx", f"{folder}/data_template.xlsx", variables, sorted(r["term"] for r in rows if not r["category"]))
    tables.write_namespace_template(made.namespaces, prefixes)
    tables.write_data_template(made.data, variables)
    return made


def standard(spark: SparkSession, workbook: str, out: str, namespaces: str | None = None, mode: str = "entire", name: str = "dataset", orcid: str = NO_ORCID, stamp: str = "00000000000000", fmt: str = "turtle", id_columns: Sequence[str] = (), prefix: str = "home", hashed: bool = False) -> tuple[DataFrame, str | None]:
    """(triples, problem) of a filled workbook, written to `out`: one document in mode "entire", else a file a row, and a
    document of what they share; hashed: Turtle, JSON-LD and its hash for each data set."""
    given, problem = tables.read_namespaces(namespaces) if namespaces else ({}, None)
    variables, df = tables.read_data_template(spark, workbook)
    if cube.EXPERIMENT not in [v.name for v in variables]:  # numbered by the reader, and a dimension like others
        variables = [Variable(cube.EXPERIMENT), *variables]
    row = None if id_columns or mode == "flat" else cube.EXPERIMENT
    triples = cube.cube_triples(df, variables, mode=mode, name=name, id_columns=id_columns, orcid=orcid, stamp=stamp, given=given, user_prefix=prefix, row=row)
    end = rdf.rdf_text.ENDINGS[fmt]
    if hashed:
        rdf.write_hashed(triples.where("g is not null"), out)
    elif mode == "entire":
        rdf.write_document(triples, f"{out}/{name}{end}", fmt)
    else:
        rdf.write_graphs(triples.where("g is not null"), out, fmt)
    if mode == "rows":
        rdf.write_document(triples.where("g is null"), f"{out}/structure{end}", fmt)
    return triples, problem


def ingest(spark: SparkSession, workbook: str, out: str, namespaces: str | None = None, orcid: str = NO_ORCID, stamp: str = "00000000000000", id_columns: Sequence[str] = (), prefix: str = "home") -> tuple[DataFrame, str | None]:
    """standard() for a store of single rows: flat triples under salted names, each row with its hash."""
    return standard(spark, workbook, out, namespaces, "flat", orcid=orcid, stamp=stamp, id_columns=id_columns, prefix=prefix, hashed=True)


def read_back(spark: SparkSession, path: str, out: str, name: str = "output") -> tuple[DataFrame, DataFrame]:
    """(table, variables) of a cube's files, saved as CSV, Parquet and JSON."""
    triples = rdf.read(spark, path).cache()
    if triples.isEmpty():
        raise FileNotFoundError(f"no RDF in {path}")
    variables = cube.read_variables(triples)
    table = cube.cube_table(triples, variables)
    tables.save(table, out, name, ("csv", "parquet"))
    variables.write.mode("overwrite").json(f"{out}/{name}_variables.json")
    return table, variables
