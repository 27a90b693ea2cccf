"""RDF files as DataFrames of triples (terms.TRIPLES), and back.

Whole documents (Turtle, JSON-LD, RDF/XML) are listed and read by Spark's binaryFile source and parsed by batches in
Python; N-Triples, whose lines stand alone, are split and parsed in the JVM, so one huge file is no bottleneck. Writing
N-Triples is a projection and a text write; the other formats are written a document a graph by a Python data source.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from hashlib import sha256
from urllib.parse import quote, urlparse
from urllib.request import url2pathname
from uuid import uuid4

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from semloom.sources import rdf_text
from semloom.terms import PREFIXES, TRIPLE_COLUMNS, TRIPLES, XSD

_DDL = "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string"
#: What reading a file that can't be parsed gives: the error's text under this predicate, if errors are kept.
ERROR = "urn:semloom:parse-error"


#: Triples that a worker holds as Python objects at once, unless one document has more. A batch of Arrow's has as many
#: documents as it likes.
AT_ONCE = 20_000


def _parsed(names: Iterable[str], texts: Iterable[bytes | str], fmt: str | None, keep_errors: bool) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for name, text in zip(names, texts, strict=True):
        try:
            text = text.decode("utf-8-sig") if isinstance(text, bytes | bytearray) else text
            rows += [(name, *t) for t in rdf_text.parse(text, fmt or rdf_text.format_of(name) or "", name)]
        except (ValueError, RecursionError) as e:
            if not keep_errors:
                raise rdf_text.RdfError(f"{name}: {e}") from e
            rows.append((name, name, ERROR, str(e)[:500], "lit", None, None))
        if len(rows) >= AT_ONCE:
            yield pd.DataFrame(rows, columns=TRIPLE_COLUMNS)
            rows = []
    yield pd.DataFrame(rows, columns=TRIPLE_COLUMNS)


def read(spark: SparkSession, path: str | Sequence[str], fmt: str | None = None, recursive: bool = True, keep_errors: bool = False) -> DataFrame:
    """Triples of all RDF files under path, g being the file. keep_errors: a file that can't be parsed gives one row
    with the predicate ERROR instead of ending the query. Files of other endings are skipped unless fmt is given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = files.load([path] if isinstance(path, str) else list(path)).select("path", "content")
    if fmt is None:
        found = found.where(F.lower("path").rlike(r"\.(" + "|".join(e[1:] for e in rdf_text.FORMATS) + ")$"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield from _parsed(f["path"], f["content"], fmt, keep_errors)

    return found.mapInPandas(run, _DDL)


def parse_column(docs: DataFrame, name: str, text: str, fmt: str = "json-ld", keep_errors: bool = False) -> DataFrame:
    """Triples of documents held in a column, g being the name column's text. Null documents have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield from _parsed(f["n"], f["t"], fmt, keep_errors)

    return docs.select(F.col(name).cast("string").alias("n"), F.col(text).alias("t")).where("t is not null").mapInPandas(run, _DDL)


def from_documents(spark: SparkSession, documents: Sequence[str | dict], keep_errors: bool = False) -> DataFrame:
    """Triples of JSON-LD documents given as texts or dicts; g is document_0, document_1, ..."""
    import json

    rows = []
    for i, d in enumerate(documents):
        if not isinstance(d, str | dict):
            raise ValueError(f"document {i} is neither a text nor a dict")
        rows.append((f"document_{i}", d if isinstance(d, str) else json.dumps(d)))
    return parse_column(spark.createDataFrame(rows, "n string, t string"), "n", "t", "json-ld", keep_errors)


_STATEMENT = r"""^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:(<[^>]*>)|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9\-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$"""


def _unescaped(c: Column) -> Column:
    """N-Triples escapes undone in the JVM; \\u escapes by way of JSON, which shares them."""
    return F.when(c.contains("\\"), F.coalesce(F.get_json_object(F.concat(F.lit('{"v":"'), F.regexp_replace(F.regexp_replace(c, r"\\'", "'"), r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1"), F.lit('"}')), "$.v"), c)).otherwise(c)


def read_ntriples(spark: SparkSession, path: str, keep_errors: bool = False) -> DataFrame:
    """Triples of N-Triples files, split by lines; g is null. A line that is neither a statement nor a comment is an
    error; keep_errors: it is a row with the predicate ERROR, the line as its object, instead."""
    line = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    good = F.col("value").rlike(_STATEMENT)
    if keep_errors:
        wrong = line.where(~good).select(*[F.lit(v).cast("string").alias(c) if c != "o" else F.col("value").alias("o") for c, v in zip(TRIPLE_COLUMNS, (None, ERROR, ERROR, None, "lit", None, None), strict=True)])
        line = line.where(good)
    else:
        line = line.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no N-Triples statement: "), F.left("value", F.lit(200)))).cast("boolean")))
    part = lambda i: F.regexp_extract("value", _STATEMENT, i)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    kind = F.when(part(3) != "", "iri").when(part(4) != "", "bnode").otherwise("lit")
    obj = F.when(part(3) != "", bare(part(3))).when(part(4) != "", part(4)).otherwise(_unescaped(part(5)))
    none = lambda c: F.when((c != "") & (c != f"{XSD}string"), c)
    out = line.select(F.lit(None).cast("string").alias("g"), bare(part(1)).alias("s"), part(2).alias("p"), obj.alias("o"), kind.alias("o_kind"), none(part(7)).alias("o_dt"), F.lower(none(part(6))).alias("o_lang"))
    return out.union(wrong) if keep_errors else out


def statement(s: Column, p: Column, o: Column, kind: Column, dt: Column, lang: Column) -> Column:
    """A line of N-Triples."""
    bracket = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    text = o
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    tail = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(dt.isNotNull(), F.concat(F.lit("^^<"), dt, F.lit(">"))).otherwise("")
    return F.concat(bracket(s), F.lit(" <"), p, F.lit("> "), F.when(kind == "lit", F.concat(F.lit('"'), text, F.lit('"'), tail)).otherwise(bracket(o)), F.lit(" ."))


def write_ntriples(triples: DataFrame, path: str, mode: str = "error") -> None:
    """The triples as N-Triples files in a folder, written by every task; graphs are dropped, repeats kept."""
    line = statement(*[F.col(c) for c in ("s", "p", "o", "o_kind", "o_dt", "o_lang")])
    triples.select(line.alias("value")).write.mode(mode).text(path)


def documents(triples: DataFrame, fmt: str = "json-ld", prefixes: Mapping[str, str] = PREFIXES) -> DataFrame:
    """(g, document): each graph's distinct triples as one text. A graph has to fit in a task's memory, as its text
    has to; a table's rows do."""
    return _documents(triples, ["g"], fmt, prefixes)


def _documents(triples: DataFrame, by: Sequence[str], fmt: str, prefixes: Mapping[str, str]) -> DataFrame:
    """(.., document) by the columns `by`, texts."""
    row = F.struct(*TRIPLE_COLUMNS[1:])
    grouped = triples.groupBy(*by).agg(F.collect_set(row).alias("ts"))
    bound = dict(prefixes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _texts(b, by, fmt, bound)

    return grouped.mapInArrow(run, ", ".join(f"{c} string" for c in (*by, "document")))


def _texts(batch: pa.RecordBatch, by: Sequence[str], fmt: str, prefixes: Mapping[str, str]) -> Iterator[pa.RecordBatch]:
    """(.. by, document) of a batch (.. by, ts), some AT_ONCE triples at a time."""
    at = size = 0
    for i, n in enumerate(pc.list_value_length(batch.column("ts")).to_pylist(), 1):
        size += n
        if size >= AT_ONCE or i == batch.num_rows:
            part = batch.slice(at, i - at)
            texts = [rdf_text.write([tuple(t.values()) for t in ts], fmt, prefixes) for ts in part.column("ts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in by), pa.array(texts, pa.string())], names=[*by, "document"])
            at, size = i, 0


def write_document(triples: DataFrame, path: str, fmt: str = "json-ld", prefixes: Mapping[str, str] = PREFIXES) -> None:
    """All triples as one document, graphs dropped. Only for what one file should hold; see write_ntriples for more."""
    rows = [tuple(r) for r in triples.select(*TRIPLE_COLUMNS[1:]).distinct().toLocalIterator()]
    fs, root = store(path)
    fs.create_dir(root.rsplit("/", 1)[0] or "/", recursive=True)
    _put(fs, root, rdf_text.write(rows, fmt, prefixes))


def _named(triples: DataFrame, fmt: str, prefixes: Mapping[str, str]) -> DataFrame:
    """(name, g, document) with graphs of one name beside each other, in order; one shuffle, by name. The name is the end
    of the graph's id; no graph is "null"."""
    end = F.regexp_extract(F.coalesce("g", F.lit("null")), r"([^/]*)/*$", 1)
    met = triples.withColumn("name", end).repartition("name")
    return _documents(met, ["name", "g"], fmt, prefixes).sortWithinPartitions("name", "g")


def _write(docs: DataFrame, folder: str, **options: str) -> None:
    docs.sparkSession.dataSource.register(RdfDocuments)
    docs.write.format("rdf_documents").options(**options).mode("append").save(folder)


def write_graphs(triples: DataFrame, folder: str, fmt: str = "json-ld", prefixes: Mapping[str, str] = PREFIXES) -> None:
    """A file a graph in a folder that all executors share, local or of a store that Arrow knows (hdfs, s3, gs).

    A file is named after the end of the graph's id. Of graphs with equal ends the first by id has that name, the others
    have a hash of their ids behind it. A file appears whole, under its name, once it is written."""
    _write(_named(triples, fmt, prefixes), folder, fmt=fmt)


def write_hashed(triples: DataFrame, folder: str, prefixes: Mapping[str, str] = PREFIXES) -> None:
    """Each graph as folder/ttl/NAME.ttl and folder/jsonld/NAME.jsonld, with the SHA-256 of the latter's bytes in
    folder/hash/NAME.jsonld.sha256. Equal graphs give equal texts, so the hash holds for the file written beside it."""
    for kind, fmt in (("ttl", "turtle"), ("jsonld", "json-ld")):
        write_graphs(triples, f"{folder}/{kind}", fmt, prefixes)
    digest = F.sha2(F.col("document").cast("binary"), 256).alias("document")
    _write(_named(triples, "json-ld", prefixes).select("name", "g", digest), f"{folder}/hash", ending=".jsonld.sha256")


# --- data source


class RdfDocuments(DataSource):
    """spark.read.format("rdf_documents").load(folder): triples, a partition a file. Writing takes (name, g, document),
    sorted by name and g, all of one name in one partition."""

    @classmethod
    def name(cls) -> str:
        return "rdf_documents"

    def schema(self):
        return TRIPLES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a local path or an IRI of a store that Arrow knows."""
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), url2pathname(urlparse(path).path) if path.startswith("file:") else path


def _put(fs: pafs.FileSystem, path: str, text: str) -> None:
    """Writes beside the place and moves there, so that nobody finds half a file."""
    folder, name = path.rsplit("/", 1) if "/" in path else (".", path)
    with fs.open_output_stream(part := f"{folder}/.{uuid4().hex}.part") as f:
        f.write(text.encode())
    fs.move(part, f"{folder}/{name}")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.fmt = options["path"], options.get("fmt")

    def partitions(self):
        fs, root = store(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file and rdf_text.format_of(x.base_name) and not x.base_name.startswith(".")]
        return [InputPartition(p) for p in sorted(x.path for x in found)] or [InputPartition("")]

    def read(self, partition):
        if not partition.value:
            return
        with store(self.path)[0].open_input_stream(partition.value) as f:
            text = f.read().decode("utf-8-sig")
        for t in rdf_text.parse(text, self.fmt or rdf_text.format_of(partition.value) or "", partition.value):
            yield (partition.value, *t)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.ending = options.get("ending") or rdf_text.ENDINGS[options.get("fmt", "json-ld")]

    def write(self, iterator):
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        before = None
        for batch in iterator:
            for end, g, document in zip(*(batch.column(c) for c in ("name", "g", "document")), strict=True):
                end, g = end.as_py(), g.as_py()
                name = quote(end, safe="-_.")
                if end == before:
                    name += "-" + sha256((g or "").encode()).hexdigest()[:12]
                before = end
                _put(fs, f"{folder}/{name}{self.ending}", document.as_py())
        return WriterCommitMessage()
