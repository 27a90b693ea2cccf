"""Command line: python -m semloom.cli COMMAND. List arguments are split at commas."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from semloom import flows
from semloom.frame import SemanticFrame, csv_folder_to_rdf, rdf_to_tables
from semloom.operators import ontology, template
from semloom.sources import rdf
from semloom.terms import HOME, NO_ORCID, PREFIXES


def _list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="semloom", description="Tables to linked data and back.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *args: tuple) -> None:
        c = sub.add_parser(name, help=help_)
        for flag, kw in args:
            c.add_argument(flag, **kw)

    onto = ("--ontology", {"help": "RDF file or folder of the ontology"})
    need = ("--ontology", {"required": True, "help": "RDF file or folder of the ontology"})
    orcid = ("--orcid", {"default": NO_ORCID})
    out = ("--out", {"required": True})
    command("filter", "terms of a domain, subdomain or stage", need, ("--query", {}), ("--kinds", {"type": _list, "default": ["domain", "subdomain", "stage"]}), ("--turtle", {"help": "file for the terms' triples"}))
    command("view-domains", "domains and subdomains as a tree", need)
    command("split-domains", "the ontology as files by domain and subdomain", need, out)
    command("add-term", "the ontology with one more term", need, out, ("--name", {"required": True}), ("--label", {}), ("--definition", {}), ("--parent", {}), ("--stage", {}))
    command("search", "subjects whose labels are near the keywords", need, ("--keywords", {"type": _list, "required": True}), ("--csv", {}))
    command("template", "a metadata template for a CSV file", ("--csv", {"required": True}), onto, out, ("--header-rows", {"action": "store_true"}))
    command("serialize", "a CSV file as linked data", ("--csv", {"required": True}), ("--template", {}), onto, out, orcid, ("--header-rows", {"action": "store_true"}), ("--format", {"default": "json-ld"}), ("--key-columns", {"type": _list}), ("--id-columns", {"type": _list, "default": []}), ("--relations", {"type": json.loads, "help": 'JSON: {"property": [["subject", "object"]]}'}), ("--license", {}), ("--bulk", {"action": "store_true"}))
    command("serialize-folder", "each CSV file of a folder as a set of linked data", ("--folder", {"required": True}), out, orcid, ("--header-rows", {"action": "store_true"}), ("--format", {"default": "json-ld"}))
    command("deserialize", "a folder of linked data as tables", ("--folder", {"required": True}), out, orcid, ("--name", {"default": "merged_output"}), ("--formats", {"type": _list, "default": ["csv", "parquet", "arrow"]}))
    command("experiment", "workbooks to fill in, with a column for each term of an ontology", out, ("--low", {"help": "RDF of the lowest-level ontology"}), ("--combined", {"help": "RDF of the combined ontology"}), ("--namespace", {"default": ""}))
    command("cube", "a data template workbook as a data cube, or a cube as a table", ("--workbook", {}), ("--namespaces", {}), ("--read", {"help": "RDF of a cube to read back"}), out, orcid, ("--mode", {"choices": ["entire", "rows", "flat"], "default": "entire"}), ("--prefix", {"default": "home"}), ("--id-columns", {"type": _list, "default": []}), ("--name", {"default": "dataset"}), ("--stamp", {"default": "00000000000000"}), ("--format", {"default": "turtle"}), ("--hashed", {"action": "store_true", "help": "Turtle, JSON-LD and its SHA-256 in folders of their own"}))
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("semloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    onto = rdf.read(spark, a.ontology).cache() if getattr(a, "ontology", None) else None
    if a.command == "filter":
        found = ontology.term_filter(onto, a.query, a.kinds)
        if a.turtle:
            rdf.write_document(ontology.subset(onto, found), a.turtle, "turtle")
        for r in found.orderBy("iri").toLocalIterator():
            print(r["iri"])
    elif a.command == "view-domains":
        print(ontology.tree_text(ontology.domain_map(ontology.subclass_edges(onto))))
    elif a.command == "split-domains":
        parts = ontology.by_subdomain(onto)
        for r in parts.select("domain", "subdomain").distinct().collect():
            own = parts.where((F.col("domain") == r["domain"]) & (F.col("subdomain") == r["subdomain"]))
            rdf.write_document(own, f"{a.out}/{r['domain']}/{r['subdomain']}.ttl", "turtle")
    elif a.command == "add-term":
        rdf.write_document(onto.unionByName(term_triples(spark, a.name, a.label, a.definition, a.parent, a.stage)), a.out, rdf.rdf_text.format_of(a.out) or "turtle")
    elif a.command == "search":
        hits = ontology.fuzzy_search(ontology.catalogue(onto), a.keywords)
        if a.csv:
            hits.write.mode("overwrite").option("header", True).csv(a.csv)
        for r in hits.orderBy("subject_id").toLocalIterator():
            print(r["subject_id"], r["label"], r["keyword"], sep="\t")
    elif a.command == "template":
        SemanticFrame.from_csv(spark, a.csv, a.header_rows, onto=onto).save_template(a.out)
    elif a.command == "serialize":
        entries = template.from_jsonld(json.loads(Path(a.template).read_text(encoding="utf-8"))) if a.template else None
        frame = SemanticFrame.from_csv(spark, a.csv, a.header_rows, onto=onto, entries=entries, orcid=a.orcid)
        if a.relations:
            frame.add_relations({k: [tuple(x) for x in v] for k, v in a.relations.items()})
        options = {"key_columns": a.key_columns, "id_columns": a.id_columns, "license": a.license}
        (frame.serialize_bulk if a.bulk else frame.serialize_rows)(a.out, a.format, **options)
    elif a.command == "serialize-folder":
        csv_folder_to_rdf(spark, a.folder, a.out, a.header_rows, a.format, orcid=a.orcid)
    elif a.command == "deserialize":
        print(*rdf_to_tables(spark, a.folder, a.out, a.name, a.formats, a.orcid), sep="\n")
    elif a.command == "experiment":
        _experiment(spark, a)
    elif a.command == "cube":
        _cube(spark, a)
    return 0


def term_triples(spark: SparkSession, name: str, label: str | None = None, definition: str | None = None, parent: str | None = None, stage: str | None = None, home: str = HOME):
    """Triples of a new class."""
    bound = {**PREFIXES, "home": home}
    full = lambda x: x if "://" in x else bound[x.split(":")[0]] + x.split(":", 1)[1] if ":" in x else home + x
    s = full(name)
    rows = [(None, s, f"{PREFIXES['rdf']}type", f"{PREFIXES['owl']}Class", "iri", None, None), (None, s, f"{PREFIXES['skos']}altLabel", label or name.split(":")[-1], "lit", None, "en")]
    if definition:
        rows.append((None, s, f"{PREFIXES['skos']}definition", definition, "lit", None, "en"))
    if parent:
        rows.append((None, s, f"{PREFIXES['rdfs']}subClassOf", full(parent), "iri", None, None))
    if stage:
        rows.append((None, s, f"{home}hasStudyStage", stage, "lit", None, None))
    return spark.createDataFrame(rows, "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string")


def _cube(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.read:
        flows.read_back(spark, a.read, a.out, a.name)
        return
    _, problem = flows.standard(spark, a.workbook, a.out, a.namespaces, a.mode, a.name, a.orcid, a.stamp, a.format, a.id_columns, a.prefix, a.hashed)
    if problem:
        print(problem, file=sys.stderr)


def _experiment(spark: SparkSession, a: argparse.Namespace) -> None:
    low, combined = ((rdf.read(spark, x) if x else None) for x in (a.low, a.combined))
    made = flows.experiment(spark, a.out, low, combined, a.namespace)
    print(f"{made.namespaces}\n{made.data}: {len(made.variables)} columns")
    for term in made.unmapped:
        print(f"no category: {term}", file=sys.stderr)


if __name__ == "__main__":
    sys.exit(main())
