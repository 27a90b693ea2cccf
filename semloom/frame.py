"""SemanticFrame: a table with its template, relations and ontology, and the operators as methods."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom import functions as S
from semloom.operators import ontology as onto_ops
from semloom.operators import reconstruct, relations, serialize, template
from semloom.operators.serialize import Entry
from semloom.session import checkpoint
from semloom.sources import rdf, tables
from semloom.terms import HELPERS, HOME, NO_ORCID, PREFIXES, TRIPLES

UNITS = "name string, label string, symbol string, ucum_code string, conversion_multiplier string, description string"


class SemanticFrame:
    """df: the table. header: (ordinal, column, type, unit, stage) if the table came with one. onto: the ontology's
    triples; without one, types are the columns' own names. verify: a check of the curator's ORCID, which may ask the
    network; without it the ORCID counts as not verified."""

    def __init__(self, df: DataFrame, header: DataFrame | None = None, *, onto: DataFrame | None = None, entries: Sequence[Entry] | None = None, units: DataFrame | None = None, orcid: str = NO_ORCID, verify: Callable[[str], bool] | None = None, base: str = HOME, name: str = "table", discover: bool = True, bindings: Mapping[str, str] = PREFIXES):
        self.spark, self.df, self.base, self.name, self.bindings = df.sparkSession, df, base, name, dict(bindings)
        one = self.spark.range(1).select(F.lit(orcid).alias("o"))
        if not one.select(S.orcid_valid("o")).first()[0]:
            raise ValueError(f"{orcid!r} is no ORCID")
        self.orcid, self.verified = orcid, bool(verify and verify(orcid))
        self.onto = onto if onto is not None else self.spark.createDataFrame([], TRIPLES)
        self.units = units if units is not None else self.spark.createDataFrame([], UNITS)
        self.columns = [c for c in df.columns if c not in HELPERS and c not in (tables.ROW, "__row__")]
        self.header = header if header is not None else self.spark.createDataFrame([(i, c, None, None, None) for i, c in enumerate(self.columns)], "ordinal int, column string, type string, unit string, stage string")
        self.matched: list[str] = []
        self.unmatched: list[str] = []
        if entries is None:
            made, matched, unmatched = template.generate(self.header, onto_ops.terms(self.onto, base), self.units, bindings=self.bindings)
            entries = template.entries(made)
            self.matched = sorted(r["line"] for r in matched.collect())
            self.unmatched = sorted(r["line"] for r in unmatched.collect())
        self.template = template.frame(self.spark, entries)
        self.relations = self.spark.createDataFrame([], relations.SCHEMA)
        if discover and onto is not None:
            self.discover()

    # --- template

    def entries(self) -> list[Entry]:
        return template.entries(self.template)

    def update(self, column: str, field: str, value: str) -> None:
        self.template = template.update(self.template, column, field, value)

    def update_bulk(self, entries: Sequence[Entry]) -> None:
        self.template = template.upsert(self.template, template.frame(self.spark, entries).drop("ordinal"))

    def add_column(self, column: str, type_: str, **more) -> bool:
        """Whether the column was new to the template."""
        self.template, new = template.add_column(self.template, column, type_, **more)
        return new

    def delete_column(self, column: str) -> None:
        self.template = template.delete_column(self.template, column)

    def overwrite(self, entries: Sequence[Entry]) -> None:
        self.template = template.frame(self.spark, entries)

    def audit(self) -> DataFrame:
        return template.audit(self.template, self.spark.createDataFrame([(c,) for c in self.columns], "column string"))

    def valid(self) -> bool:
        return template.aligned(self.audit())

    def view(self) -> DataFrame:
        return template.view(self.template)

    def save_template(self, path: str, matched: str | None = None, unmatched: str | None = None) -> None:
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps(template.to_jsonld(self.entries(), self.bindings), indent=2), encoding="utf-8")
        for p, lines in ((matched, self.matched), (unmatched, sorted(set(self.unmatched)))):
            if p:
                Path(p).write_text("".join(f"{x}\n" for x in lines), encoding="utf-8")

    # --- relations

    def properties(self) -> DataFrame:
        return onto_ops.properties(self.onto)

    def discover(self) -> None:
        """Adds the relations that the ontology's domains and ranges allow between the columns."""
        cols = self.template.select(F.col("alt_label").alias("column"), S.expand("type", self.bindings).alias("iri"))
        found = relations.discover(self.onto, cols).select(F.col("prop").alias("property"), F.col("prop").alias("iri"), F.lit("object").alias("kind"), "subject", "object")
        self.relations = relations.add(self.relations, found)

    def add_relations(self, pairs: Mapping[str, Sequence[tuple[str, str]]]) -> None:
        keys = relations.resolve(relations.frame(self.spark, pairs), self.properties(), self.bindings)
        self.relations = relations.add(self.relations, keys.select("property", "iri", "kind", "subject", "object"))

    def delete_relation(self, property: str, pairs: Sequence[tuple[str, str]] | None = None) -> None:
        self.relations = relations.delete(self.relations, property, pairs, self.bindings)

    def validate_relations(self) -> DataFrame:
        return relations.validate(self.relations, self.columns)

    def save_relations(self, path: str) -> None:
        """The relations as JSON, and as text beside it."""
        rows = self.relations.orderBy("property", "subject", "object").collect()
        by: dict[str, list] = {}
        for r in rows:
            by.setdefault(r["property"], []).append([r["subject"], r["object"]])
        target = Path(path)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.with_suffix(".json").write_text(json.dumps(by, indent=2), encoding="utf-8")
        target.with_suffix(".txt").write_text(relations.text(self.relations), encoding="utf-8")

    # --- out

    def triples(self, **options) -> DataFrame:
        """serialize.table_triples with the frame's template, relations and curator."""
        known = [r["iri"] for r in onto_ops.classes(self.onto).collect()]  # an ontology's classes: thousands at most
        return serialize.table_triples(self.df, self.entries(), orcid=self.orcid, verified=self.verified, relations=relations.rows(self.relations), classes=known or None, base=self.base, row_column=tables.ROW if tables.ROW in self.df.columns else None, bindings=self.bindings, **options)

    def serialize_rows(self, folder: str, fmt: str = "json-ld", **options) -> None:
        """A file a row in a shared folder, and the licence's triple if one is given."""
        rdf.write_graphs(self.triples(**options), folder, fmt, self.bindings)
        self._license(folder, fmt, options)

    def serialize_bulk(self, path: str, fmt: str = "nt", **options) -> None:
        """All triples as one set: N-Triples by all tasks into a folder, other formats as one document."""
        union = serialize.merged(self.triples(**options))
        if fmt == "nt":
            rdf.write_ntriples(union, path, "overwrite")
        else:
            rdf.write_document(union, path, fmt, self.bindings)
        self._license(str(Path(path).parent), fmt, options)

    def _license(self, folder: str, fmt: str, options: Mapping) -> None:
        if options.get("license"):
            rows = serialize.license_triple(self.spark, options["license"], self.base, options.get("licenses"))
            end = rdf.rdf_text.ENDINGS[fmt]
            rdf.write_document(rows, f"{folder}/dataset_license{end}", fmt, self.bindings)

    def save(self, folder: str, formats: Sequence[str] = ("csv", "parquet", "arrow"), with_header: bool = False, order: str | None = None) -> list[str]:
        """The table in each format, the template and the relations beside it. with_header: types, units and stages as
        the CSV's first rows; the rows then go by `order`, a unique column."""
        head = reconstruct.with_header_rows(self.df, self.entries(), order or self.columns[0]) if with_header else None
        done = tables.save(self.df, folder, self.name, formats, head)
        self.save_template(f"{folder}/{self.name}_template.jsonld", f"{folder}/{self.name}_matched.txt", f"{folder}/{self.name}_unmatched.txt")
        self.save_relations(f"{folder}/{self.name}_relations.json")
        return done

    def __repr__(self) -> str:
        return f"SemanticFrame({self.name}, {len(self.columns)} columns, {self.relations.count()} relations)"

    # --- in

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, header_rows: bool = False, **options) -> SemanticFrame:
        df, header = tables.read_csv(spark, path, header_rows)
        return cls(df, header, **{"name": Path(path).stem, **options})

    @classmethod
    def from_triples(cls, triples: DataFrame, entries: Sequence[Entry] | None = None, report: str | None = None, **options) -> SemanticFrame:
        """The table of triples, a row a graph, described by the given template or what the triples themselves say.
        report: a file for the audit of units and types."""
        found = checkpoint(reconstruct.entities(triples, options.get("base", HOME)))  # read for labels, template, audit and table
        if report:
            Path(report).parent.mkdir(parents=True, exist_ok=True)
            Path(report).write_text(reconstruct.report(reconstruct.conflicts(found, entries, stored=True)), encoding="utf-8")
        labels = reconstruct.labels_of(found)
        if entries is not None:
            labels = sorted({*labels, *(e.alt_label for e in entries)})
        made = list(entries) if entries is not None else reconstruct.template_entries(reconstruct.first_definitions(found))
        return cls(reconstruct.wide(found, labels), entries=made, **options)

    @classmethod
    def from_rdf(cls, spark: SparkSession, folder: str, **options) -> SemanticFrame:
        """The table of a folder of RDF files; files that can't be parsed are left out."""
        return cls.from_triples(rdf.read(spark, folder, keep_errors=True).where(F.col("p") != rdf.ERROR), **options)

    @classmethod
    def from_documents(cls, spark: SparkSession, documents: Sequence[str | dict], **options) -> SemanticFrame:
        return cls.from_triples(rdf.from_documents(spark, documents), **options)


def csv_folder_to_rdf(spark: SparkSession, folder: str, out: str, header_rows: bool = False, fmt: str = "json-ld", **options) -> list[str]:
    """Each CSV file of a folder as a set of its own: out/NAME/ has its rows as RDF files, and its template and relations."""
    done = []
    for path in tables.csv_files(spark, folder):
        frame = SemanticFrame.from_csv(spark, path, header_rows, **options)
        target = f"{out}/{frame.name}"
        frame.serialize_rows(f"{target}/rows", fmt)
        frame.save_template(f"{target}/{frame.name}_template.jsonld", f"{target}/{frame.name}_matched.txt", f"{target}/{frame.name}_unmatched.txt")
        frame.save_relations(f"{target}/{frame.name}_relations.json")
        done.append(target)
    return done


def rdf_to_tables(spark: SparkSession, folder: str, out: str, name: str = "merged_output", formats: Sequence[str] = ("csv", "parquet", "arrow"), orcid: str = NO_ORCID) -> list[str]:
    """A folder of RDF files as one table with header rows."""
    frame = SemanticFrame.from_rdf(spark, folder, name=name, orcid=orcid, report=f"{out}/{name}_report.txt")
    return frame.save(out, formats, with_header="csv" in formats, order="__source_file__")
