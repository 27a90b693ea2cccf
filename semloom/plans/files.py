"""Queries that write files from the test tables and read them back: sources, sinks, templates, recorded runs."""

from __future__ import annotations

import json
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom import flows
from semloom import frame as frames
from semloom.operators import cube, provenance, reconstruct, relations, serialize, template
from semloom.operators.cube import Variable
from semloom.operators.serialize import Entry
from semloom.plans import sqltext as Q
from semloom.plans.queries import AT, CUSTOMER, NATION, ORCID, query, sql_values, table, values
from semloom.session import shared_folder
from semloom.sources import rdf, tables
from semloom.terms import CUBE_PREFIXES, HOME, NO_DEFINITION, OWL, RDF, RDFS, SKOS


def place(spark: SparkSession) -> str:
    """A new folder for a query's files."""
    folder = f"{shared_folder(spark)}/files-{uuid4().hex}"
    fs, path = rdf.store(folder)
    fs.create_dir(path, recursive=True)
    return folder


def local(path: str) -> Path:
    """The same for files that people fill in, which lie on this machine."""
    return Path(rdf.store(path)[1])


def put(df: DataFrame, path: Path) -> None:
    """A small table as one CSV file of a given name."""
    path.parent.mkdir(parents=True, exist_ok=True)
    df.toPandas().to_csv(path, index=False)


# --- CSV


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def csv_read(spark, d):
    path = f"{place(spark)}/customer"
    table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.option("header", True).csv(path)
    return tables.read_csv(spark, path)[0]


@query("""SELECT n_name || chr(10) || '"' || n_regionkey || '", ' AS name, CAST(n_nationkey AS VARCHAR) AS key FROM nation""")
def csv_line_breaks(spark, d):
    """Cells with line breaks, quotes and commas."""
    path = local(place(spark)) / "nation.csv"
    put(table(spark, d, "nation").select(F.concat("n_name", F.lit('\n"'), F.col("n_regionkey").cast("string"), F.lit('", ')).alias("name"), F.col("n_nationkey").alias("key")), path)
    path.write_text(path.read_text().replace('""', '\\"'))  # Spark's own escape
    return tables.read_csv(spark, str(path))[0]


def _with_header(spark, d) -> str:
    folder, s = place(spark), table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"))
    entries = [Entry("s_suppkey", "home:SupplierKey"), Entry("s_name", "home:SupplierName", stage="Sample"), Entry("nation", "home:NationKey", unit="NUM", stage="Recipe")]
    tables.save(s, folder, "supplier", ["csv"], reconstruct.with_header_rows(s, entries, "s_suppkey"))
    return f"{folder}/supplier.csv"


@query('SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS VARCHAR) AS "__Label__", CAST(s_nationkey AS VARCHAR) AS nation, s_name, CAST(s_suppkey AS VARCHAR) AS s_suppkey, 2 + row_number() OVER (ORDER BY s_suppkey) AS "__row_idx__" FROM supplier')
def csv_header_rows(spark, d):
    return tables.read_csv(spark, _with_header(spark, d), header_rows=True)[0]


@query("SELECT * FROM (SELECT 0 AS ordinal, '__Label__' AS \"column\", 'Type' AS type, 'Units' AS unit, 'Study Stage' AS stage UNION ALL SELECT 1, 'nation', 'home:NationKey', 'unit:NUM', 'Recipe' UNION ALL SELECT 2, 's_name', 'home:SupplierName', 'unit:UNITLESS', 'Sample' UNION ALL SELECT 3, 's_suppkey', 'home:SupplierKey', 'unit:UNITLESS', NULL) h")
def csv_header(spark, d):
    return tables.read_csv(spark, _with_header(spark, d), header_rows=True)[1]


def _two_files(spark, d) -> Path:
    folder = local(place(spark))
    put(table(spark, d, "nation").withColumnRenamed("n_regionkey", "region"), folder / "nation.csv")
    put(table(spark, d, "region").withColumnRenamed("r_regionkey", "region"), folder / "region.csv")
    return folder


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS region, NULL::VARCHAR AS r_name, 'nation.csv' AS \"__source_file__\" FROM nation UNION ALL SELECT NULL, NULL, CAST(r_regionkey AS VARCHAR), r_name, 'region.csv' FROM region")
def csv_folder(spark, d):
    return tables.read_csv_folder(spark, str(_two_files(spark, d)))


@query("""SELECT 'nation' AS set, l AS label, CAST(CASE l WHEN 'n_nationkey' THEN n_nationkey ELSE n_regionkey END AS VARCHAR) AS value FROM nation, (VALUES ('n_nationkey'), ('region')) v(l) UNION ALL SELECT 'nation', 'n_name', n_name FROM nation
UNION ALL SELECT 'region', 'region', CAST(r_regionkey AS VARCHAR) FROM region UNION ALL SELECT 'region', 'r_name', r_name FROM region""")
def csv_folder_outputs(spark, d):
    """A set of RDF files for each CSV file, read back."""
    out = place(spark)
    done = frames.csv_folder_to_rdf(spark, str(_two_files(spark, d)), out, orcid=ORCID)
    sets = [reconstruct.entities(rdf.read(spark, f"{x}/rows")).select(F.lit(x.rsplit("/", 1)[1]).alias("set"), "label", "value") for x in done]
    return sets[0].unionByName(sets[1])


# --- RDF

_NATIONS = Q.triples("nation", NATION, ORCID, AT)


def _nations(spark, d, fmt: str) -> DataFrame:
    """A file a row of nation, read back without the files' names."""
    folder = place(spark)
    rdf.write_graphs(serialize.table_triples(table(spark, d, "nation"), NATION, orcid=ORCID, generated_at=AT), folder, fmt)
    return rdf.read(spark, folder).drop("g")


@query(f"SELECT s, p, o, o_kind, o_dt, o_lang FROM ({_NATIONS}) t")
def rdf_turtle_files(spark, d):
    return _nations(spark, d, "turtle")


@query(f"SELECT s, p, o, o_kind, o_dt, o_lang FROM ({_NATIONS}) t")
def rdf_jsonld_files(spark, d):
    return _nations(spark, d, "json-ld")


@query(f"SELECT s, p, o, o_kind, o_dt, o_lang FROM ({_NATIONS}) t")
def rdf_xml_files(spark, d):
    return _nations(spark, d, "xml")


@query("SELECT CASE WHEN part = 1 THEN '' ELSE '-' || substr(sha256('urn:set2/' || n_nationkey), 1, 12) END AS tail, count(*) AS n FROM nation, (VALUES (1), (2)) v(part) GROUP BY ALL")
def rdf_equal_names(spark, d):
    """Graphs whose ids end alike get files of their own."""
    n, folder = table(spark, d, "nation"), place(spark)
    t = [serialize.emit(n, F.concat(F.lit(f"urn:set{i}/"), F.col("n_nationkey").cast("string")), [serialize.triple(F.lit("urn:s"), "urn:p", F.col("n_name"))]) for i in (1, 2)]
    rdf.write_graphs(t[0].unionByName(t[1]), folder, "nt")
    names = rdf.read(spark, folder).select(F.regexp_extract("g", r"/\d+(-[0-9a-f]+)?\.nt$", 1).alias("tail"))
    return names.groupBy("tail").agg(F.count("*").alias("n"))


@query(f"SELECT s, p, o, o_kind, o_dt, o_lang FROM ({Q.triples('customer', CUSTOMER, ORCID, AT)}) t")
def ntriples_files(spark, d):
    path = f"{place(spark)}/customers"
    rdf.write_ntriples(serialize.table_triples(table(spark, d, "customer"), CUSTOMER, orcid=ORCID, generated_at=AT), path)
    return rdf.read_ntriples(spark, path).drop("g")


@query("SELECT 'nothing ' || n_nationkey AS line FROM nation")
def ntriples_errors(spark, d):
    """Lines that are no statements, kept as errors."""
    path, n = f"{place(spark)}/lines", F.col("n_nationkey").cast("string")
    table(spark, d, "nation").select(F.explode(F.array(F.concat(F.lit("<urn:a"), n, F.lit('> <urn:b> "c" .')), F.concat(F.lit("nothing "), n), F.lit("# a comment"), F.lit(""))).alias("value")).write.text(path)
    return rdf.read_ntriples(spark, path, keep_errors=True).where(F.col("p") == rdf.ERROR).select(F.col("o").alias("line"))


@query(f"SELECT DISTINCT s, p, o, o_kind FROM ({_NATIONS}) t")
def rdf_union_document(spark, d):
    """All rows as one Turtle document."""
    path = f"{place(spark)}/nation.ttl"
    rdf.write_document(serialize.merged(serialize.table_triples(table(spark, d, "nation"), NATION, orcid=ORCID, generated_at=AT)), path, "turtle")
    return rdf.read(spark, path).select("s", "p", "o", "o_kind")


# --- cubes and workbooks

_SUPPLIERS = [Variable("s_suppkey"), Variable("s_name", alt_label="Name", category="Who"), Variable("s_acctbal", True, "Balance", "Money", "USD")]


def _cube_files(spark, d) -> str:
    folder = place(spark)
    t = cube.cube_triples(table(spark, d, "supplier"), _SUPPLIERS, mode="rows", id_columns=["s_suppkey"], orcid=ORCID, stamp="T")
    rdf.write_hashed(t, folder)
    return folder


@query("SELECT s_name, s_acctbal FROM supplier")
def cube_files(spark, d):
    """A cube as Turtle files and back to its table."""
    out = cube.cube_table(rdf.read(spark, f"{_cube_files(spark, d)}/ttl"))
    return out.select("s_name", "s_acctbal")


@query("SELECT count(*) AS files, count(*) AS equal FROM supplier")
def cube_hashes(spark, d):
    """The hash beside each JSON-LD file is its bytes'."""
    folder = _cube_files(spark, d)
    name = lambda end: F.regexp_extract("path", rf"/([^/]*){end}$", 1)
    load = lambda at, glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f"{folder}/{at}")
    said = load("hash", "*.sha256").select(name(r"\.jsonld\.sha256").alias("name"), F.col("content").cast("string").alias("said"))
    have = load("jsonld", "Dataset*.jsonld").select(name(r"\.jsonld").alias("name"), F.sha2("content", 256).alias("have"))
    return have.join(said, "name", "left").agg(F.count("*").alias("files"), F.sum(F.when(F.col("said") == F.col("have"), 1).otherwise(0)).alias("equal"))


@query('SELECT row_number() OVER (ORDER BY n_nationkey) AS "ExperimentId", n_name AS nation_name, n_regionkey AS region FROM nation')
def workbook_data(spark, d):
    """A workbook filled in and read back: names without spaces, empty columns gone, rows numbered."""
    path = local(place(spark)) / "data.xlsx"
    v = [Variable("nation name", category="Where"), Variable("region", True, "Region", "Where", "NUM"), Variable("nothing")]
    rows = [[r["n_name"], r["n_regionkey"], None] for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]
    tables.write_data_template(str(path), v, rows)
    return tables.read_data_template(spark, str(path))[1]


@query(f"SELECT prefix, iri FROM {sql_values('prefix, iri', *sorted(CUBE_PREFIXES.items()))} WHERE prefix NOT LIKE 'reg%' UNION ALL SELECT lower(r_name), 'urn:' || r_regionkey || '#' FROM region")
def workbook_namespaces(spark, d):
    path = local(place(spark)) / "names.xlsx"
    own = {r["r_name"]: f"urn:{r['r_regionkey']}#" for r in table(spark, d, "region").collect()}
    tables.write_namespace_template(str(path), own)
    found, problem = tables.read_namespaces(str(path))
    assert problem is None
    return values(spark, "prefix string, iri string", *found.items())


@query("""SELECT fmt, CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CASE WHEN s_nationkey < 5 THEN NULL ELSE CAST(s_nationkey AS VARCHAR) END AS s_nationkey FROM supplier, (VALUES ('arrow'), ('parquet'), ('csv')) v(fmt)""")
def table_exports(spark, d):
    """The same table in each format, nulls as nulls."""
    folder = place(spark)
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_nationkey") >= 5, F.col("s_nationkey")).alias("s_nationkey"))
    tables.save(s, str(local(folder)), "supplier")
    read = {"csv": spark.read.option("header", True).csv(f"{folder}/supplier.csv"), "parquet": spark.read.parquet(f"{folder}/supplier.parquet"), "arrow": tables.read_arrow(spark, str(local(folder) / "supplier.arrow"))}
    out = [df.select(F.lit(fmt).alias("fmt"), "s_suppkey", "s_name", "s_nationkey") for fmt, df in read.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query('SELECT n_name AS "licenseId", \'Licence \' || n_nationkey AS name, n_regionkey = 1 AS "isOsiApproved", n_regionkey = 2 AS "isDeprecatedLicenseId" FROM nation')
def license_list(spark, d):
    path = local(place(spark)) / "licenses.json"
    rows = [{"licenseId": r["n_name"], "name": f"Licence {r['n_nationkey']}", "isOsiApproved": r["n_regionkey"] == 1, "isDeprecatedLicenseId": r["n_regionkey"] == 2} for r in table(spark, d, "nation").collect()]
    path.write_text(json.dumps({"licenseListVersion": "1", "licenses": rows}, indent=1))
    return tables.licenses(spark, str(path))


@query("""WITH x AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation WHERE n_regionkey IN (0, 1)) SELECT CAST(i AS VARCHAR) AS "ExperimentId", CAST(NULL AS VARCHAR) AS r0, n_nationkey * 1.0::DOUBLE AS r1 FROM x WHERE n_regionkey = 1""")
def experiment_flow(spark, d):
    """Ontology, leaf categories, workbook, filled in, cube files, and their table."""
    n, folder = table(spark, d, "nation"), place(spark)
    iri = lambda kind, c: F.concat(F.lit(HOME + kind), F.col(c).cast("string"))
    sub, kind = serialize.triple(iri("r", "n_regionkey"), f"{RDFS}subClassOf", F.lit(f"{HOME}Top"), "iri"), lambda c: serialize.triple(c, f"{RDF}type", F.lit(f"{OWL}Class"), "iri")
    onto = serialize.emit(n, None, [sub, kind(iri("r", "n_regionkey")), kind(F.lit(f"{HOME}Top"))]).distinct()
    broader = serialize.emit(n, None, [serialize.triple(iri("r", "n_regionkey"), f"{SKOS}broader", F.lit(f"{HOME}Top"), "iri")]).distinct()
    made = flows.experiment(spark, folder, onto, onto.unionByName(broader))
    assert sorted(v.name for v in made.variables) == [f"r{i}" for i in range(5)] and {v.category for v in made.variables} == {"Top"}
    v = [x._replace(is_measure=x.name == "r1") for x in made.variables]
    rows = [[r["n_name"] if x.name == "r0" and r["n_regionkey"] == 0 else float(r["n_nationkey"]) if x.name == "r1" and r["n_regionkey"] == 1 else None for x in v] for r in n.where("n_regionkey in (0, 1)").orderBy("n_nationkey").collect()]
    tables.write_data_template(made.data, v, rows)
    flows.standard(spark, made.data, f"{folder}/rdf", made.namespaces, name="nations", orcid=ORCID, stamp="T")
    out, _ = flows.read_back(spark, f"{folder}/rdf", f"{folder}/out")
    return out


@query("SELECT count(*) AS rows, count(*) AS hashes FROM nation")
def ingestion_flow(spark, d):
    """A filled workbook as flat triples of single rows, each with the hash of its file."""
    folder = place(spark)
    v = [Variable("nation"), Variable("region", True, unit="NUM")]
    tables.write_data_template(str(local(folder) / "data.xlsx"), v, [[r["n_name"], r["n_regionkey"]] for r in table(spark, d, "nation").collect()])
    flows.ingest(spark, str(local(folder) / "data.xlsx"), f"{folder}/out", orcid=ORCID, stamp="T", id_columns=["nation"])
    files = lambda at: spark.read.format("binaryFile").load(f"{folder}/out/{at}")
    said = files("hash").select(F.col("content").cast("string").alias("h"))
    have = files("jsonld").select(F.sha2("content", 256).alias("h"))
    return have.join(said.distinct(), "h", "left_semi").agg(F.count("*").alias("hashes")).crossJoin(files("ttl").agg(F.count("*").alias("rows"))).select("rows", "hashes")


# --- templates, relations, reports

BRANDS = "SELECT row_number() OVER (ORDER BY p_brand) - 1 AS ordinal, p_brand AS alt_label, 'home:' || min(p_type) AS type, 'About ' || min(p_name) AS definition, 'unit' || max(p_size) AS unit, CASE WHEN max(p_size) > 45 THEN 'Sample' ELSE '' END AS stage, '' AS note FROM part GROUP BY p_brand"


def brands(spark, d) -> DataFrame:
    """A template of a row a brand."""
    b = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_type").alias("t"), F.min("p_name").alias("n"), F.max("p_size").alias("z"))
    order = F.expr("row_number() over (order by p_brand) - 1").cast("int")  # a row a brand
    return b.select(order.alias("ordinal"), F.col("p_brand").alias("alt_label"), F.concat(F.lit("home:"), "t").alias("type"), F.concat(F.lit("About "), "n").alias("definition"), F.concat(F.lit("unit"), F.col("z").cast("string")).alias("unit"), F.when(F.col("z") > 45, "Sample").otherwise("").alias("stage"), F.lit("").alias("note"))


@query(f"SELECT alt_label, type, definition, unit, stage FROM ({BRANDS}) t")
def template_document(spark, d):
    """A template as a JSON-LD file and back."""
    path = local(place(spark)) / "template.jsonld"
    path.write_text(json.dumps(template.to_jsonld(template.entries(brands(spark, d)))))
    back = template.from_jsonld(json.loads(path.read_text()))
    return template.frame(spark, back).select("alt_label", "type", "definition", "unit", "stage")


@query("SELECT 'near' AS property, n_name AS subject, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey")
def relations_file(spark, d):
    """Relations as a JSON file and back."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    f = frames.SemanticFrame(n, entries=NATION, orcid=ORCID)
    f.add_relations({"near": [(r["n_name"], r["r_name"]) for r in n.select("n_name", "r_name").collect()]})
    path = local(place(spark)) / "relations.json"
    f.save_relations(str(path))
    return relations.frame(spark, json.loads(path.read_text()))


_GIVEN = f"h AS (SELECT row_number() OVER (ORDER BY p_name) - 1 AS ordinal, p_name, min(p_brand) AS b FROM part GROUP BY p_name), t AS (SELECT p_name, {Q.normalize('p_name')} AS k FROM h WHERE p_name LIKE 'red %')"


@query(f"""WITH {_GIVEN}, u AS (SELECT DISTINCT 'u' || p_type AS unit, p_type FROM part) SELECT CAST(ordinal AS INTEGER) AS ordinal, h.p_name AS alt_label, CASE WHEN b = 'Brand#1' THEN 'other:' || b WHEN t.p_name IS NOT NULL THEN 'home:' || t.k ELSE 'home:' || {Q.normalize('h.p_name')} END AS type,
CASE WHEN b <> 'Brand#1' AND t.p_name IS NOT NULL THEN 'def ' || t.p_name ELSE '{NO_DEFINITION}' END AS definition, CASE WHEN ordinal % 3 = 0 THEN 'KiloGM' WHEN ordinal % 3 = 1 THEN 'M' ELSE 'UNITLESS' END AS unit,
CASE WHEN b = 'Brand#1' THEN 'Recipe' WHEN t.p_name IS NOT NULL THEN 'Sample' ELSE '' END AS stage FROM h LEFT JOIN t ON t.p_name = h.p_name""")
def template_generation(spark, d):
    """A template of a header: columns with a term, without one, and with a type of their own; units by cell."""
    h = table(spark, d, "part").groupBy("p_name").agg(F.min("p_brand").alias("b"))
    order = F.expr("row_number() over (order by p_name) - 1").cast("int")  # a row a name
    h = h.withColumn("ordinal", order)
    cell = F.when(F.col("ordinal") % 3 == 0, "unit:KiloGM").when(F.col("ordinal") % 3 == 1, "metre")
    header = h.select("ordinal", F.col("p_name").alias("column"), F.when(F.col("b") == "Brand#1", F.concat(F.lit("other:"), "b")).alias("type"), cell.alias("unit"), F.lit("Recipe").alias("stage"))
    term = h.where("p_name like 'red %'").select(F.concat(F.lit(HOME), F.regexp_replace("p_name", " ", "_")).alias("iri"), F.col("p_name").alias("label"), F.lit(0).alias("rank"), F.concat(F.lit("def "), "p_name").alias("definition"), F.lit("Sample").alias("stage"))
    # names that only differ in the colour are similar, so they are told apart by a long word
    far = lambda c: F.when(F.col(c).startswith("red "), F.col(c)).otherwise(F.concat(F.repeat(F.lit("z"), 60), F.col(c)))
    known = values(spark, "name string, label string, ucum_code string", ("M", "Metre", "m"), ("GM", "Gram", "g"))
    made, _, _ = template.generate(header.withColumn("column", far("column")), term, known)
    plain = lambda c: F.regexp_replace(c, "z{60}", "").alias(c)
    return made.select("ordinal", plain("alt_label"), plain("type"), "definition", "unit", "stage")


def _regions(spark, d) -> DataFrame:
    """Nations as entities of their regions; units go by the parity of the nation, so they conflict."""
    n = table(spark, d, "nation")
    unit = F.concat(F.lit("unit:"), (F.col("n_nationkey") % 2).cast("string"))
    return n.select(F.format_string("n%03d", "n_nationkey").alias("g"), F.lit("s").alias("s"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("label"), F.col("n_name").alias("value"), unit.alias("unit"), F.lit("urn:t").alias("type"), *[F.lit(None).cast("string").alias(c) for c in ("definition", "stage", "note")])


@query("""WITH e AS (SELECT printf('n%03d', n_nationkey) AS g, 'r' || n_regionkey AS label, 'unit:' || (n_nationkey % 2) AS unit FROM nation), f AS (SELECT label, min_by(unit, g) AS want, min(g) AS origin FROM e GROUP BY label), bad AS (SELECT e.*, want, origin FROM e JOIN f ON f.label = e.label WHERE unit <> want)
SELECT count(*) || ' conflicts of units and types' AS line FROM bad UNION ALL SELECT '- ' || label || ' in ' || g || ': unit ' || unit || ', expected ' || want || ' (' || origin || ')' FROM bad""")
def conflict_report(spark, d):
    text = reconstruct.report(reconstruct.conflicts(_regions(spark, d)))
    return values(spark, "line string", *[(x,) for x in text.splitlines()])


# --- recorded runs


def _runs(spark, d) -> provenance.Group:
    """A run a region: how many nations it has, and the sum of their keys."""
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("keys")).join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))

    def count_nations(region: str, keys: list, scale: float = 1.5):
        if region == "ASIA":
            raise ValueError("no")
        return len(keys), sum(keys) * scale

    group = provenance.Group("nations", ORCID, group_id="g1")
    for r in n.collect():
        group.run(count_nations, r["r_name"], sorted(r["keys"]), tracker=provenance.Tracker("nations", ORCID, run_id=f"run{r['n_regionkey']}"))
    return group


_RUNS = "r AS (SELECT r_regionkey AS k, r_name AS name, count(*) AS n, sum(n_nationkey) * 1.5 AS total FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"


@query(f"""WITH {_RUNS} SELECT 'run' || k AS "__rowkey__", 'nations' AS "ProjectTitle", name AS region, 'keys.run' || k AS "keys", '1.5' AS scale, CASE WHEN name <> 'ASIA' THEN CAST(n AS VARCHAR) END AS first, CASE WHEN name <> 'ASIA' THEN CAST(CAST(total AS DOUBLE) AS VARCHAR) END AS second FROM r""")
def provenance_rows(spark, d):
    """A row a run, columns that a run lacks null."""
    f = _runs(spark, d).run_frame(spark)
    return f.select("__rowkey__", "ProjectTitle", "region", "keys", "scale", F.col("count_nations_output_0").alias("first"), F.col("count_nations_output_1").alias("second"))


@query(f"""WITH {_RUNS} SELECT 'run' || k AS run, v.name, v.kind, CASE v.name WHEN 'region' THEN r.name WHEN 'scale' THEN '1.5' END AS value, CASE WHEN v.name = 'keys' THEN CAST(n AS VARCHAR) END AS shape FROM r, (VALUES ('region', 'str'), ('keys', 'list'), ('scale', 'float')) v(name, kind)
UNION ALL SELECT 'run' || k, 'count_nations_output_0', 'int', CAST(n AS VARCHAR), NULL FROM r WHERE name <> 'ASIA' UNION ALL SELECT 'run' || k, 'count_nations_output_1', 'float', CAST(CAST(total AS DOUBLE) AS VARCHAR), NULL FROM r WHERE name <> 'ASIA'""")
def provenance_sources(spark, d):
    """The values that went into the runs and came out, by kind."""
    out = None
    for t in _runs(spark, d).trackers.values():
        s = t.source_frame(spark).where("arg_type <> 'error'").select(F.lit(t.id).alias("run"), "name", F.col("arg_type").alias("kind"), "value", "shape")
        out = s if out is None else out.unionByName(s)
    return out


@query(f"""WITH {_RUNS} SELECT 'run' || k AS run, 'count_nations' AS function, CAST(3 AS INTEGER) AS used, CAST(CASE WHEN name = 'ASIA' THEN 1 ELSE 2 END AS INTEGER) AS made, CASE WHEN name = 'ASIA' THEN 'ValueError: no' END AS error FROM r""")
def provenance_activities(spark, d):
    out = None
    for t in _runs(spark, d).trackers.values():
        a = t.activity_frame(spark).select(F.lit(t.id).alias("run"), "function", F.size("used").alias("used"), F.size("generated").alias("made"), "error")
        out = a if out is None else out.unionByName(a)
    return out


@query(f"""SELECT '{HOME}g1' AS s, '{HOME}hasComponent' AS p, '{HOME}run' || r_regionkey AS o FROM region UNION ALL SELECT '{HOME}run' || r_regionkey, 'http://purl.org/dc/terms/title', 'nations' FROM region UNION ALL SELECT '{HOME}g1', 'http://purl.org/dc/terms/title', 'nations'""")
def provenance_group(spark, d):
    """The group's triples: its runs, and what they are called."""
    t = _runs(spark, d).triples(spark)
    return t.where(F.col("p").isin(f"{HOME}hasComponent", "http://purl.org/dc/terms/title")).select("s", "p", "o")


@query("WITH c AS (SELECT unnest(['region', 'keys', 'scale']) AS l UNION ALL SELECT 'count_nations_output_0' UNION ALL SELECT 'count_nations_output_1') SELECT l AS alt_label, CASE WHEN l = 'region' THEN 'home:Region_of_the_world' ELSE 'home:' || lower(l) END AS type FROM c UNION ALL SELECT 'ProjectTitle', 'home:projecttitle'")
def provenance_template(spark, d):
    """A template of the runs' columns, matched with terms."""
    term = values(spark, "iri string, label string, rank int, definition string, stage string", (f"{HOME}Region_of_the_world", "Region", 0, "d", "Sample"))
    made, _, _ = _runs(spark, d).row_template(spark, term, values(spark, "name string, label string, ucum_code string", ("M", "Metre", "m")))
    return made.select("alt_label", "type")


@query(f"""WITH {_RUNS} SELECT '- count_nations: 3 in, ' || CASE WHEN name = 'ASIA' THEN '1 out, failed with ValueError: no' ELSE '2 out' END AS line FROM r""")
def provenance_report(spark, d):
    lines = _runs(spark, d).report().splitlines()
    return values(spark, "line string", *[(x,) for x in lines if x.startswith("- count_nations: ")])

