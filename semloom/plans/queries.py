"""The engine's operators as queries over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom import functions as S
from semloom.operators import cube, ontology, reconstruct, serialize, template
from semloom.operators.cube import Variable
from semloom.operators.serialize import Entry, Relation
from semloom.plans import sqltext as Q
from semloom.session import checkpoint, stored
from semloom.sources import rdf
from semloom.terms import DCT, ENTITY_IRI, HOME, LICENSES_AT, QB, QUDT, RDF, RDFS, SDMX, SKOS, XSD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ORCID = "0000-0001-2345-6789"
AT = "2024-01-01T00:00:00Z"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, ddl: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), ddl)


def sql_values(names: str, *rows: tuple) -> str:
    """The rows as a FROM item of SQL."""
    cell = lambda v: "CAST(NULL AS VARCHAR)" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else Q.text(v)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + f") AS v({names})"


CUSTOMER = [Entry("c_custkey", "home:CustomerKey", "The customer's number", "UNITLESS", "Sample"), Entry("c_name", "home:CustomerName", "The customer's name", "UNITLESS", "Sample"), Entry("c_mktsegment", "home:Segment", "Market segment", "UNITLESS", "Result"), Entry("c_acctbal", "home:Balance", "Balance of the account", "USD", "Result")]
NATION = [Entry("n_nationkey", "home:NationKey", "Number", "UNITLESS", "Sample"), Entry("n_name", "home:NationName", "Name", "UNITLESS", "Sample"), Entry("n_regionkey", "home:RegionKey", "Region", "UNITLESS", "Result")]
PART = [Entry("p_partkey", "home:PartKey", "Number", "UNITLESS", "Sample"), Entry("p_name", "home:PartName", "Name", "UNITLESS", "Formulation"), Entry("p_type", "home:PartType", "Type", "UNITLESS", "Formulation"), Entry("p_size", "home:PartSize", "Size", "MilliM", "Result")]


# --- tables to triples


@query(Q.triples("customer", CUSTOMER, ORCID, AT))
def serialize_table(spark, d):
    return serialize.table_triples(table(spark, d, "customer"), CUSTOMER, orcid=ORCID, generated_at=AT)


@query(Q.triples("part", PART, ORCID, AT))
def serialize_parts(spark, d):
    return serialize.table_triples(table(spark, d, "part"), PART, orcid=ORCID, generated_at=AT)


_ORDERS = [Entry("o_orderkey", "home:OrderKey", "Number", "UNITLESS", ""), Entry("o_orderstatus", "home:OrderStatus", "Status", "UNITLESS", "")]


@query(Q.triples("(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders)", _ORDERS, ORCID, AT, key="trim(CAST(o_orderkey AS VARCHAR))"))
def entity_melt_na(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"))
    return serialize.table_triples(o, _ORDERS, orcid=ORCID, generated_at=AT, key_columns=["o_orderkey", "unknown"])


@query(f"""SELECT DISTINCT '{HOME}NationName.' || regexp_replace(replace(lower(n_name), ' ', '_'), '[^A-Za-z0-_.]', '', 'g') AS s, '{HOME}inRegion' AS p, '{HOME}' || n_regionkey AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_dt FROM nation
UNION ALL SELECT DISTINCT '{HOME}NationName.' || regexp_replace(replace(lower(n_name), ' ', '_'), '[^A-Za-z0-_.]', '', 'g'), '{HOME}number', CAST(n_nationkey AS VARCHAR), 'lit', '{XSD}integer' FROM nation""")
def typed_triples(spark, d):
    rel = [Relation("home:inRegion", "object", "n_name", "n_regionkey"), Relation("home:number", "datatype", "n_name", "n_nationkey"), Relation("home:unknown", None, "n_name", "n_nationkey")]
    t = serialize.table_triples(table(spark, d, "nation"), [NATION[1]], orcid=ORCID, id_columns=["n_name"], relations=rel)
    return t.where(F.col("p").isin(f"{HOME}inRegion", f"{HOME}number", f"{HOME}unknown")).select("s", "p", "o", "o_kind", "o_dt").distinct()


@query(f"""SELECT '{HOME}NationKey.' || k AS s, '{HOME}inRegion' AS p, '{HOME}RegionKey.' || k AS o FROM (SELECT {Q.row_key(NATION)} AS k FROM nation)""")
def object_links(spark, d):
    t = serialize.table_triples(table(spark, d, "nation"), NATION, orcid=ORCID, relations=[Relation("home:inRegion", "object", "n_nationkey", "n_regionkey")])
    return t.where(F.col("p") == f"{HOME}inRegion").select("s", "p", "o")


@query(f"SELECT '{HOME}SupplierKey.' || s_suppkey AS s, trim(s_name) AS o FROM supplier")
def label_pairs(spark, d):
    t = serialize.table_triples(table(spark, d, "supplier"), [Entry("s_suppkey", "home:SupplierKey")], orcid=ORCID, id_columns=["s_suppkey"], label_pairs=[("s_suppkey", "s_name")])
    return t.where(F.col("p") == f"{RDFS}label").select("s", "o")


@query(f"""WITH t AS ({Q.triples("nation", NATION, ORCID, AT, key="trim(CAST(n_regionkey AS VARCHAR))")}) SELECT DISTINCT CAST(NULL AS VARCHAR) AS g, s, p, o, o_kind, o_dt, o_lang FROM t""")
def graph_union_distinct(spark, d):
    return serialize.merged(serialize.table_triples(table(spark, d, "nation"), NATION, orcid=ORCID, generated_at=AT, key_columns=["n_regionkey"]))


_KNOWN = [f"{HOME}PartKey", f"{HOME}PartSize", f"{HOME}PartType"]


@query(Q.triples("part", PART, ORCID, AT, types=[f"{HOME}PartKey", ENTITY_IRI, f"{HOME}PartType", f"{HOME}PartSize"]))
def firewall_template(spark, d):
    return serialize.table_triples(table(spark, d, "part"), PART, orcid=ORCID, generated_at=AT, classes=_KNOWN)


@query(f"""WITH t AS (SELECT 'urn:part:' || p_brand AS s, '{HOME}' || p_type AS o FROM part), u AS (SELECT DISTINCT s, o FROM t),
ok AS (SELECT s, bool_and(o IN ('{HOME}ECONOMY', '{HOME}STANDARD', '{HOME}LARGE')) AS ok FROM u GROUP BY s)
SELECT DISTINCT u.s, CASE WHEN ok THEN u.o ELSE '{ENTITY_IRI}' END AS o FROM u JOIN ok USING (s)""")
def firewall_remap(spark, d):
    p = table(spark, d, "part")
    t = serialize.emit(p, None, [serialize.triple(F.concat(F.lit("urn:part:"), "p_brand"), f"{RDF}type", F.concat(F.lit(HOME), "p_type"), "iri")]).distinct()
    known = values(spark, "iri string", (f"{HOME}ECONOMY",), (f"{HOME}STANDARD",), (f"{HOME}LARGE",))
    return serialize.firewall(t, known).select("s", "o").distinct()


@query("""SELECT '<urn:n:' || n_nationkey || '> <urn:name> "' || n_name || '" .' AS line FROM nation""")
def ntriples_lines(spark, d):
    t = serialize.emit(table(spark, d, "nation"), None, [serialize.triple(F.concat(F.lit("urn:n:"), F.col("n_nationkey").cast("string")), "urn:name", F.col("n_name"))])
    return t.select(rdf.statement(*[F.col(c) for c in ("s", "p", "o", "o_kind", "o_dt", "o_lang")]).alias("line"))


@query("SELECT 'doc' || page_id AS g, url AS s, 'urn:length' AS p, CAST(length(html) AS VARCHAR) AS o, 'http://www.w3.org/2001/XMLSchema#integer' AS o_dt FROM pages")
def jsonld_parse(spark, d):
    """JSON-LD documents made of each page, parsed back."""
    p = table(spark, d, "pages")
    doc = F.to_json(F.struct(F.struct(F.lit("urn:").alias("u")).alias("@context"), F.col("url").alias("@id"), F.length("html").alias("u:length")))
    docs = p.select(F.concat(F.lit("doc"), F.col("page_id").cast("string")).alias("n"), doc.alias("t"))
    return rdf.parse_column(docs, "n", "t").select("g", "s", "p", "o", "o_dt")


# --- triples to tables


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def pivot_roundtrip(spark, d):
    t = serialize.table_triples(table(spark, d, "nation"), NATION, orcid=ORCID)
    return reconstruct.wide(reconstruct.entities(t), source=None)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, CAST(NULL AS VARCHAR) AS o_comment FROM orders")
def pivot_backfill(spark, d):
    return reconstruct.wide(reconstruct.entities(entity_melt_na(spark, d)), ["o_orderkey", "o_orderstatus", "o_comment"], source=None)


def event_entities(spark, d):
    """Events as entities: the type is the label, the parity of the user the unit, so units conflict."""
    e = table(spark, d, "events")
    return e.select(F.format_string("e%09d", "event_id").alias("g"), F.lit("s").alias("s"), F.col("event_type").alias("label"), F.col("value").cast("string").alias("value"), F.concat(F.lit("unit:"), (F.col("user_id") % 2).cast("string")).alias("unit"), F.concat(F.lit("type:"), "event_type").alias("type"), F.lit(None).cast("string").alias("definition"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("note"))


EVENTS = "e AS (SELECT printf('e%09d', event_id) AS g, event_type AS label, 'unit:' || (user_id % 2) AS unit FROM events)"


@query(f"WITH {EVENTS} SELECT label, min_by(unit, g) AS unit, min(g) AS origin FROM e GROUP BY label")
def first_seen(spark, d):
    return reconstruct.first_definitions(event_entities(spark, d)).select("label", "unit", "origin")


@query(f"WITH {EVENTS}, f AS (SELECT label, min_by(unit, g) AS expected, min(g) AS expected_from FROM e GROUP BY label) SELECT e.g, e.label, 'unit' AS kind, f.expected, e.unit AS found, f.expected_from FROM e JOIN f ON e.label = f.label WHERE e.unit <> f.expected")
def first_seen_conflict(spark, d):
    return reconstruct.conflicts(event_entities(spark, d))


@query(f"WITH {EVENTS}, f AS (SELECT label, min_by(unit, g) AS expected FROM e GROUP BY label) SELECT 'unit' AS kind, count(*) AS n FROM e JOIN f ON e.label = f.label WHERE e.unit <> f.expected")
def conflict_counts(spark, d):
    return reconstruct.conflict_counts(first_seen_conflict(spark, d))


@query(f"SELECT '{HOME}inRegion' AS property, 'n_name' AS subject, 'n_nationkey' AS object, 'missing' AS kind, count(*) AS n FROM nation")
def relation_conflict(spark, d):
    t = serialize.table_triples(table(spark, d, "nation"), NATION, orcid=ORCID, relations=[Relation("home:near", "object", "n_nationkey", "n_regionkey")])
    asked = [Relation("home:near", "object", "n_nationkey", "n_regionkey"), Relation("home:inRegion", "object", "n_name", "n_nationkey")]
    return reconstruct.relation_conflicts(t, reconstruct.entities(t), asked).groupBy("property", "subject", "object", "kind").agg(F.count("*").alias("n"))


@query("""SELECT -2 AS __row__, 'Type' AS __Label__, 'home:RegionName' AS r_name, 'home:RegionKey' AS r_regionkey
UNION ALL SELECT -1, 'Units', 'unit:UNITLESS', 'unit:UNITLESS' UNION ALL SELECT 0, 'Study Stage', 'Sample', ''
UNION ALL SELECT row_number() OVER (ORDER BY r_regionkey), CAST(row_number() OVER (ORDER BY r_regionkey) AS VARCHAR), r_name, CAST(r_regionkey AS VARCHAR) FROM region""")
def header_split_export(spark, d):
    return reconstruct.with_header_rows(table(spark, d, "region"), [Entry("r_regionkey", "home:RegionKey"), Entry("r_name", "home:RegionName", stage="Sample")], "r_regionkey")


@query("""SELECT 'o_orderkey' AS "column", count(*) AS n, count(*) - count(o_orderkey) AS n_null FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders UNION ALL SELECT 'o_orderpriority', count(*), count(*) FILTER (WHERE o_orderpriority = '5-LOW') FROM orders""")
def null_column_profile(spark, d):
    o = table(spark, d, "orders")
    return reconstruct.null_profile(o.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority")))


@query("SELECT s_name AS name, CAST(s_suppkey AS VARCHAR) AS s_suppkey, CAST(NULL AS VARCHAR) AS c_mktsegment FROM supplier UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer")
def outer_union_runs(spark, d):
    return reconstruct.outer_union(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("s_suppkey")), table(spark, d, "customer").select(F.col("c_name").alias("name"), "c_mktsegment"))


@query("SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS nth FROM events")
def label_occurrence(spark, d):
    f = event_entities(spark, d).withColumn("event_id", F.substr("g", F.lit(2)).cast("bigint"))
    return reconstruct.occurrence(f).select("event_id", F.col("label").alias("event_type"), F.col("nth").cast("bigint").alias("nth"))


# --- keys and scalar functions


@query(f"SELECT p_partkey, {Q.row_key(PART)} AS row_key FROM part")
def row_key_hash6(spark, d):
    return table(spark, d, "part").withColumn("row_key", serialize.key_column(PART)).select("p_partkey", "row_key")


@query(f"SELECT page_id, {Q.hash6('html')} AS h FROM pages")
def hash6_text(spark, d):
    return table(spark, d, "pages").select("page_id", S.hash6("html").alias("h"))


@query("SELECT p_partkey, trim(CAST(p_partkey AS VARCHAR)) || '-' || coalesce(nullif(p_brand, 'Brand#2'), '') AS k, replace(trim(CAST(p_partkey AS VARCHAR)) || '-' || coalesce(nullif(p_brand, 'Brand#2'), '') || '-or0000000123456789', ' ', '') AS f FROM part")
def key_columns(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#2")).alias("b"))
    k = S.key_from_columns(["p_partkey", "b"])
    return p.select("p_partkey", k.alias("k"), S.full_row_key(k, F.lit(ORCID)).alias("f"))


@query(f"SELECT p_partkey, {Q.normalize('p_name')} AS a, {Q.normalize('p_brand')} AS b, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS c FROM part")
def normalize_label(spark, d):
    return table(spark, d, "part").select("p_partkey", S.normalize("p_name").alias("a"), S.normalize("p_brand").alias("b"), S.normalize_strict("p_brand").alias("c"))


@query(f"SELECT page_id, {Q.normalize('url')} AS a, {Q.normalize('url', '/')} AS b FROM pages")
def normalize_urls(spark, d):
    return table(spark, d, "pages").select("page_id", S.normalize("url").alias("a"), S.normalize_iri("url").alias("b"))


@query("SELECT page_id, string_split(url, '/')[-1] AS l, regexp_extract(url, '([^/#]*)$', 1) AS f, regexp_extract(url, '^(.*[/#])', 1) AS b FROM pages")
def local_name(spark, d):
    return table(spark, d, "pages").select("page_id", S.local_name("url").alias("l"), S.fragment("url").alias("f"), S.base_iri("url").alias("b"))


_BIND = {"web": "http://", "web2": "https://", "blog": "http://blog.", "blog2": "https://blog.", "mob": "https://m."}


@query("""SELECT page_id, CASE WHEN url LIKE 'https://blog.%' THEN 'blog2:' || substr(url, 14) WHEN url LIKE 'http://blog.%' THEN 'blog:' || substr(url, 13) WHEN url LIKE 'https://m.%' THEN 'mob:' || substr(url, 11) WHEN url LIKE 'https://%' THEN 'web2:' || substr(url, 9) WHEN url LIKE 'http://%' THEN 'web:' || substr(url, 8) ELSE 'obo:BFO_0000001' END AS c,
CASE WHEN url LIKE 'http://%' THEN 'web:' || substr(url, 8) WHEN url LIKE 'https://%' THEN 'web2:' || substr(url, 9) ELSE url END AS n FROM pages""")
def curie_prefix(spark, d):
    return table(spark, d, "pages").select("page_id", S.curie("url", _BIND).alias("c"), S.prefixed_name("url", _BIND).alias("n"))


_NAMES = (("home:x",), ("http://a.b/c",), ("nope:x",), ("bare",), ("https://a.b/c#d",), ("skos:altLabel",))


@query(f"SELECT name, CASE WHEN regexp_matches(name, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') THEN name WHEN name LIKE 'home:%' THEN '{HOME}' || substr(name, 6) WHEN name LIKE 'skos:%' THEN '{SKOS}' || substr(name, 6) END AS iri, CASE WHEN contains(name, '://') THEN regexp_extract(name, '([^/#]*)$', 1) WHEN contains(name, ':') THEN substr(name, instr(name, ':') + 1) ELSE name END AS local FROM {sql_values('name', *_NAMES)}")
def expand_names(spark, d):
    return values(spark, "name string", *_NAMES).select("name", S.expand("name").alias("iri"), S.type_local_name("name").alias("local"))


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g'), '^([0-9])', '_\\1'), '_+', '_', 'g'), '_') AS i, {Q.sanitize_filename('url')} AS f FROM pages")
def sanitize_names(spark, d):
    return table(spark, d, "pages").select("page_id", S.sanitize_iri("url").alias("i"), S.sanitize_filename("url").alias("f"))


@query(f"SELECT doc_id, {Q.sanitize_filename('text')} AS f FROM documents")
def sanitize_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", S.sanitize_filename("text").alias("f"))


@query("SELECT page_id, url_encode(url) AS e FROM pages")
def percent_encode(spark, d):
    return table(spark, d, "pages").select("page_id", S.percent_encode("url").alias("e"))


@query("SELECT page_id, sha256(html) AS h FROM pages")
def content_sha256(spark, d):
    return table(spark, d, "pages").select("page_id", S.content_sha256("html").alias("h"))


@query("SELECT o_orderkey, substr('abcdefghijklmnopqrstuvwxyz', CAST(CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 26 + 1 AS INTEGER), 1) AS salt FROM orders")
def salted_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.salt_letter("o_orderkey").alias("salt"))


@query("SELECT vec_id, CAST(len(embedding) AS VARCHAR) AS shape FROM embeddings")
def shape_string(spark, d):
    return table(spark, d, "embeddings").select("vec_id", S.shape_string("embedding").alias("shape"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, strftime(ts, '%Y%m%d%H%M%S') AS compact FROM events")
def instants(spark, d):
    return table(spark, d, "events").select("event_id", S.iso_instant("ts").alias("iso"), S.compact_instant("ts").alias("compact"))


_ORCIDS = (("0000-0001-2345-6789",), ("0000-0001-2345-678X",), ("0000",), ("0000-0001-2345-67890",))


@query(f"SELECT o, regexp_matches(o, '^[0-9]{{4}}(-[0-9]{{4}}){{3}}$') AS ok, regexp_replace(o, '[^0-9]', '', 'g') AS digits, regexp_matches(o, '^[A-Za-z0-9]+$') AS plain FROM {sql_values('o', *_ORCIDS)}")
def orcid_checks(spark, d):
    return values(spark, "o string", *_ORCIDS).select("o", S.orcid_valid("o").alias("ok"), S.digits("o").alias("digits"), S.alnum_id("o").alias("plain"))


_LIC = (("MIT", "MIT License", True), ("Apache-2.0", "Apache License 2.0", True), ("CC0-1.0", "Creative Commons Zero v1.0 Universal", False), ("CC-BY-4.0", "Creative Commons Attribution 4.0", False))


@query(f"SELECT * FROM {sql_values('\"licenseId\", name, osi', *_LIC)} WHERE contains(lower(\"licenseId\"), 'apache') OR contains(lower(name), 'apache')")
def license_filter(spark, d):
    return ontology.search_licenses(values(spark, "licenseId string, name string, osi boolean", *_LIC), "APACHE")


_LICS = ((None,), ("",), ("MIT",), ("http://x.y/z",))


@query(f"SELECT l, CASE WHEN coalesce(l, '') = '' THEN '{LICENSES_AT}CC0-1.0.html' WHEN l LIKE 'http%' THEN l ELSE '{LICENSES_AT}' || l || '.html' END AS iri FROM {sql_values('l', *_LICS)}")
def license_iris(spark, d):
    return values(spark, "l string", *_LICS).select("l", S.license_iri("l", ["MIT"]).alias("iri"))


@query("SELECT p_partkey, CASE WHEN length(p_name) <= 2 THEN 0 WHEN length(p_name) <= 5 THEN 1 ELSE 2 END AS dist, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 8) || '...' ELSE p_name END AS short, p_brand || '_' || p_type AS ident FROM part")
def label_helpers(spark, d):
    return table(spark, d, "part").select("p_partkey", S.adaptive_distance("p_name").alias("dist"), S.shorten("p_name", 8).alias("short"), S.id_string("p_brand", "p_type").alias("ident"))


# --- templates and relations

_TERMS = (("urn:t:widget", "Red Widget"), ("urn:t:ring", "small ring"), ("urn:t:ring2", "SMALL RING"), ("urn:t:cog", "blue cog"))
_TERM_SQL = f"t AS (SELECT iri, label, {Q.normalize('label')} AS k FROM {sql_values('iri, label', *_TERMS)}), f AS (SELECT k, min(iri) AS iri, arg_min(label, iri) AS term FROM t GROUP BY k), c AS (SELECT DISTINCT p_name AS c, {Q.normalize('p_name')} AS k FROM part)"


@query(f'WITH {_TERM_SQL} SELECT c AS "column", iri, term FROM c JOIN f ON c.k = f.k')
def term_exact_match(spark, d):
    return template.exact_matches(table(spark, d, "part"), values(spark, "iri string, label string", *_TERMS), "p_name")


@query(f'WITH {_TERM_SQL} SELECT c AS "column" FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.k = c.k)')
def term_unmatched(spark, d):
    p = table(spark, d, "part")
    return template.unmatched(p, template.exact_matches(p, values(spark, "iri string, label string", *_TERMS), "p_name"), "p_name")


@query()
def term_fuzzy_ratio(spark, d):
    """Matching-block ratios have no SQL form; the tests hold them against the standard library's own."""
    return template.fuzzy_matches(table(spark, d, "part"), values(spark, "iri string, label string", *_TERMS), "p_name")


@query(f"SELECT p_partkey, p_name FROM part WHERE {Q.near('p_name', 'widgt', 1)}")
def near_match_search(spark, d):
    return table(spark, d, "part").where(S.near_match("p_name", "widgt")).select("p_partkey", "p_name")


@query(f"SELECT p_partkey, CASE WHEN {Q.near('p_name', 'smal', 1)} THEN 'smal' ELSE 'bracket' END AS keyword FROM part WHERE {Q.near('p_name', 'smal', 1)} OR {Q.near('p_name', 'bracket', 2)}")
def dedup_first_keyword(spark, d):
    return ontology.fuzzy_search(table(spark, d, "part"), ["smal", "bracket"], "p_name").select("p_partkey", "keyword")


@query("""SELECT 'urn:brand:' || p_brand AS subject_id, min(p_name) AS label, array_to_string(list_sort(list_distinct(list_concat(list('rdf-schema#label → ' || p_name), list('type → ' || p_type)))), ' | ') AS info FROM part GROUP BY p_brand""".replace("rdf-schema#label", "label"))
def subject_catalogue(spark, d):
    s = F.concat(F.lit("urn:brand:"), "p_brand")
    return ontology.catalogue(serialize.emit(table(spark, d, "part"), None, [serialize.triple(s, f"{RDFS}label", F.col("p_name")), serialize.triple(s, f"{HOME}type", F.col("p_type"))]))


# --- joins and sets


_META = "SELECT p_brand AS name, bool_or(p_size > 45) AS is_measure, min(nullif(p_name, 'small ring')) AS alt_label, min(p_type) AS category, list_sort(list_distinct(list(p_type))) AS units, CAST(NULL AS VARCHAR) AS existing FROM part GROUP BY p_brand"


@query(_META.replace("list_sort(list_distinct(list(p_type)))", "array_to_string(list_sort(list_distinct(list(p_type))), ',')"))
def metadata_merge(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_brand").alias("name"), (F.col("p_size") > 45).alias("is_measure"), F.nullif("p_name", F.lit("small ring")).alias("alt_label"), F.col("p_type").alias("category"), F.array("p_type").alias("units"), F.lit(None).cast("string").alias("existing"))
    return cube.merge_variables(rows).withColumn("units", F.array_join("units", ","))


# --- cubes

_ORDER_VARS = [Variable("o_orderkey"), Variable("o_orderstatus", alt_label="Status", category="Order facts"), Variable("o_totalprice", True, "Price", "Money", "USD"), Variable("o_custkey", True)]


@query(f"SELECT o_orderkey, 'o_totalprice' AS measure, 0 AS ordinal, CAST(o_totalprice AS VARCHAR) AS value, '{XSD}double' AS datatype FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', 1, o_orderpriority, CAST(NULL AS VARCHAR) FROM orders WHERE o_orderpriority <> '5-LOW'")
def observation_melt(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return cube.observations(o, [Variable("o_totalprice", True), Variable("o_orderpriority", True)], ["o_orderkey"])


@query("WITH m AS (SELECT o_orderkey, 0 AS ordinal FROM orders UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderpriority <> '5-LOW') SELECT o_orderkey, ordinal, row_number() OVER (ORDER BY o_orderkey, ordinal) AS observation FROM m")
def observation_numbers(spark, d):
    return cube.numbered_observations(observation_melt(spark, d), "o_orderkey").select("o_orderkey", "ordinal", F.col("observation").cast("bigint").alias("observation"))


@query(f"""SELECT '{HOME}Slice_0000000123456789_T_' || o_orderkey AS s, '{HOME}o_orderstatus' AS p, coalesce(nullif(o_orderstatus, 'P'), '{HOME}NotFound') AS o, CASE WHEN o_orderstatus = 'P' THEN 'iri' ELSE 'lit' END AS o_kind FROM orders""")
def slice_notfound(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))).select("o_orderkey", "o_orderstatus", "o_totalprice")
    t = cube.cube_triples(o, [Variable("o_orderstatus"), Variable("o_totalprice", True)], name="orders", orcid=ORCID, stamp="T", row="o_orderkey")
    return t.where((F.col("p") == f"{HOME}o_orderstatus") & F.col("s").contains("/Slice_")).select("s", "p", "o", "o_kind")


@query(f"""WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS VARCHAR) AS v, '{HOME}observation_0000000123456789_T_' || o_orderkey || '_1' AS obs FROM orders)
SELECT '{HOME}Slice_0000000123456789_T_' || o_orderkey AS s, '{QB}observation' AS p, obs AS o FROM o UNION ALL SELECT obs, '{RDF}type', '{QB}Observation' FROM o UNION ALL SELECT obs, '{QB}measureType', '{HOME}o_totalprice' FROM o
UNION ALL SELECT obs, '{HOME}o_totalprice', v FROM o UNION ALL SELECT obs, '{SDMX}attribute#unitMeasure', '{HOME}USD' FROM o UNION ALL SELECT obs, '{HOME}o_orderstatus', o_orderstatus FROM o""")
def cube_observations(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    t = cube.cube_triples(o, [Variable("o_orderstatus"), Variable("o_totalprice", True, unit="USD")], name="orders", orcid=ORCID, stamp="T", row="o_orderkey", fixed=[])
    return t.where(F.col("s").contains("/observation_") | (F.col("p") == f"{QB}observation")).select("s", "p", "o")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders")
def cube_readback(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_totalprice", "o_custkey")
    # read several times, so written once, as a cube's files are
    return cube.cube_table(stored(cube.cube_triples(o, _ORDER_VARS, name="orders", orcid=ORCID, stamp="T", row="o_orderkey")))


@query(f"""WITH s AS (SELECT *, substr('abcdefghijklmnopqrstuvwxyz', CAST(CAST('0x' || substr(sha256(k), 1, 8) AS BIGINT) % 26 + 1 AS INTEGER), 1) || '-' || k AS n FROM (SELECT *, CAST(s_suppkey AS VARCHAR) || '-0000000123456789-T' AS k FROM supplier))
SELECT '{HOME}' || n AS g, '{HOME}s_acctbal-' || n AS s, '{QUDT}value' AS p, CAST(s_acctbal AS VARCHAR) AS o, '{XSD}float' AS o_dt FROM s UNION ALL SELECT '{HOME}' || n, '{HOME}s_name-' || n, '{QUDT}value', s_name, CAST(NULL AS VARCHAR) FROM s
UNION ALL SELECT '{HOME}' || n, '{HOME}s_acctbal-' || n, '{QUDT}hasUnit', '{HOME}USD', NULL FROM s UNION ALL SELECT '{HOME}' || n, '{HOME}s_name-' || n, '{QUDT}hasUnit', '_:u' || substr(sha256('{HOME}s_name-' || n), 1, 16), NULL FROM s""")
def salted_flat_row(spark, d):
    t = cube.cube_triples(table(spark, d, "supplier"), [Variable("s_acctbal", True, unit="USD"), Variable("s_name")], mode="flat", id_columns=["s_suppkey"], orcid=ORCID, stamp="T")
    return t.where(F.col("p") != f"{RDF}type").select("g", "s", "p", "o", "o_dt")


@query(f"""WITH s AS (SELECT {Q.sanitize_filename('s_name')} || '_0000000123456789_T' AS n, s_acctbal FROM supplier)
SELECT '{HOME}Dataset_' || n AS g, '{HOME}Dataset_' || n AS s, '{DCT}title' AS p, 'Dataset_' || n AS o FROM s UNION ALL SELECT '{HOME}Dataset_' || n, '{HOME}Dataset_' || n, '{QB}slice', '{HOME}Slice_' || n FROM s
UNION ALL SELECT '{HOME}Dataset_' || n, '{HOME}observation_' || n || '_1', '{HOME}s_acctbal', CAST(s_acctbal AS VARCHAR) FROM s""")
def cube_rows(spark, d):
    t = cube.cube_triples(table(spark, d, "supplier"), [Variable("s_nationkey"), Variable("s_acctbal", True)], mode="rows", id_columns=["s_name"], orcid=ORCID, stamp="T")
    return t.where(F.col("p").isin(f"{DCT}title", f"{QB}slice") | (F.col("p") == f"{HOME}s_acctbal")).where("g is not null and not s like '%SliceKey%'").select("g", "s", "p", "o")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS \"ExperimentId\" FROM orders")
def experiment_id_fill(spark, d):
    return cube.fill_experiment_ids(table(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", F.col("ExperimentId").cast("bigint").alias("ExperimentId"))


# --- hierarchies


def _edges(spark, d):
    """Nations below their regions, those below a root, and each region beside the next: a cycle."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    region = lambda c: F.concat(F.lit("r"), c.cast("string"))
    up = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), region(F.col("n_regionkey")).alias("parent"))
    return up.union(r.select(region(F.col("r_regionkey")), F.lit("world"))).union(r.select(region(F.col("r_regionkey")), region((F.col("r_regionkey") + 1) % 5)))


_EDGES = "e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region UNION SELECT 'r' || r_regionkey, 'r' || ((r_regionkey + 1) % 5) FROM region)"
_TREE = "e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region)"


def _tree(spark, d):
    return _edges(spark, d).where("not (child like 'r%' and parent like 'r%')")


@query(f"""WITH RECURSIVE {_EDGES}, n AS (SELECT child AS x FROM e UNION SELECT parent FROM e), c(child, ancestor, depth) AS (SELECT x, x, 0 FROM n UNION SELECT c.child, e.parent, c.depth + 1 FROM c JOIN e ON e.child = c.ancestor WHERE c.depth < 8)
SELECT child, ancestor, min(depth) AS depth FROM c GROUP BY ALL""")
def superclass_closure(spark, d):
    return ontology.closure(_edges(spark, d))


@query(f"WITH {_TREE} SELECT child, 'world' AS root FROM (SELECT child FROM e UNION SELECT 'world')")
def root_domain(spark, d):
    return ontology.root_domains(_tree(spark, d))


@query("SELECT 'world' AS domain, array_to_string(list_sort(list('r' || r_regionkey)), ',') AS subdomains FROM region")
def domain_map(spark, d):
    return ontology.domain_map(_tree(spark, d)).withColumn("subdomains", F.array_join("subdomains", ","))


@query("SELECT 'urn:n:' || n_nationkey AS iri FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
def term_filter(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    t = serialize.emit(n, None, [serialize.triple(F.concat(F.lit("urn:n:"), F.col("n_nationkey").cast("string")), f"{HOME}inDomain", F.concat(F.lit("urn:r:"), F.col("n_regionkey").cast("string")), "iri")])
    named = serialize.emit(r, None, [serialize.triple(F.concat(F.lit("urn:r:"), F.col("r_regionkey").cast("string")), f"{RDFS}label", F.col("r_name"))])
    return ontology.term_filter(t.unionByName(named), "asia")


def _class_triples(edges: DataFrame, p: str) -> DataFrame:
    return serialize.emit(edges, None, [serialize.triple(F.concat(F.lit("urn:"), "child"), p, F.concat(F.lit("urn:"), "parent"), "iri")])


@query(f"WITH {_TREE} SELECT DISTINCT 'urn:' || child AS iri FROM e WHERE child NOT IN (SELECT parent FROM e)")
def leaf_classes(spark, d):
    return ontology.leaf_classes(_class_triples(_tree(spark, d), f"{RDFS}subClassOf"))


@query("SELECT 'urn:n' || n_nationkey AS iri, 'urn:r' || n_regionkey AS top FROM nation")
def leaf_classification(spark, d):
    t = _class_triples(_edges(spark, d), f"{RDFS}subClassOf")
    tops = table(spark, d, "region").select(F.concat(F.lit("urn:r"), F.col("r_regionkey").cast("string")).alias("iri"))
    return ontology.classify_leaves(t, table(spark, d, "nation").select(F.concat(F.lit("urn:n"), F.col("n_nationkey").cast("string")).alias("iri")), tops)


_QUDT = ontology.QUDT_SCHEMA


@query("SELECT r_name AS kind, array_to_string(list_sort(list(n_name)), ',') AS units FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1".replace("r_name AS kind", "regexp_replace(replace(lower(r_name), ' ', '_'), '[^A-Za-z0-_.]', '', 'g') AS kind"))
def quantity_kinds(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("r_regionkey = n_regionkey"))
    t = serialize.emit(n, None, [serialize.triple(F.concat(F.lit("urn:k/"), "r_name"), f"{_QUDT}applicableUnit", F.concat(F.lit("urn:u/"), "n_name"), "iri")])
    return ontology.quantity_kinds(t).withColumn("units", F.array_join("units", ","))


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def observations_by_window(spark, d):
    from semloom.streaming import windowed_counts

    return windowed_counts(table(spark, d, "events"), "ts", "event_type")


from semloom.plans import files, metadata  # noqa: E402, F401  register their queries with these
