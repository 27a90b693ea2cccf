"""Queries over templates, relations, ontologies and structures that are made of the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom import functions as S
from semloom.operators import cube, ontology, reconstruct, relations, serialize, template
from semloom.operators.cube import Variable
from semloom.operators.serialize import Entry
from semloom.plans import sqltext as Q
from semloom.plans.files import BRANDS, brands
from semloom.plans.queries import AT, CUSTOMER, EVENTS, ORCID, event_entities, query, serialize_table, table, values
from semloom.session import checkpoint, stored
from semloom.sources import rdf
from semloom.terms import DCT, GENERIC_TYPE, HOME, LICENSES_AT, NO_DEFINITION, OWL, QB, QUDT, RDF, RDFS, SDMX, SKOS

_FIELDS = "CAST(ordinal AS INTEGER) AS ordinal, alt_label, type, definition, unit, stage, note"


@query(f"SELECT '{HOME}Dataset' AS s, '{DCT}license' AS p, '{LICENSES_AT}' || r_name || '.html' AS o, 'iri' AS o_kind FROM region")
def license_triple(spark, d):
    names = sorted(r["r_name"] for r in table(spark, d, "region").collect())
    out = [serialize.license_triple(spark, n, licenses=names).select("s", "p", "o", "o_kind") for n in names]
    return out[0].union(out[1]).union(out[2]).union(out[3]).union(out[4])


@query(f"""WITH t AS MATERIALIZED ({Q.triples("customer", CUSTOMER, ORCID, AT)}), l AS (SELECT g, s, o AS label, row(g, s) AS spot FROM t WHERE p = '{SKOS}altLabel'), x AS (SELECT g, s, max(CASE WHEN p = '{RDF}type' THEN o END) AS type, max(CASE WHEN p = '{QUDT}hasUnit' THEN o END) AS unit FROM t GROUP BY g, s)
SELECT label, min_by(type, spot) AS type, min_by(unit, spot) AS unit FROM l JOIN x ON x.g = l.g AND x.s = l.s GROUP BY label""")
def template_of_triples(spark, d):
    return reconstruct.definitions_of(serialize_table(spark, d)).select("label", "type", "unit")


@query(f"""WITH {EVENTS}, f AS (SELECT label, min_by(unit, g) AS want, min(g) AS origin FROM e GROUP BY label)
SELECT g, label, 'unit' AS kind, 'https://qudt.org/vocab/unit/UNITLESS' AS expected, unit AS found, 'template' AS expected_from FROM e WHERE label = 'click' UNION ALL SELECT g, label, 'type', '{HOME}Click', 'type:click', 'template' FROM e WHERE label = 'click'
UNION ALL SELECT e.g, e.label, 'unit', want, unit, origin FROM e JOIN f ON f.label = e.label WHERE e.label <> 'click' AND unit <> want""")
def template_conflict(spark, d):
    """A template that has one of the labels; the others' first definitions count."""
    return reconstruct.conflicts(event_entities(spark, d), [Entry("click", "home:Click")])


# --- templates


@query(f"""WITH b AS ({BRANDS}) SELECT CAST(ordinal AS INTEGER) AS ordinal, alt_label, CASE WHEN stage = 'Sample' THEN 'home:B2' ELSE type END AS type, definition, CASE WHEN stage = 'Sample' THEN 'KiloGM' ELSE unit END AS unit, stage, note FROM b
UNION ALL SELECT (SELECT CAST(max(ordinal) + 1 AS INTEGER) FROM b), n_name, '{GENERIC_TYPE}', '{NO_DEFINITION}', 'UNITLESS', 'UNK', '' FROM nation""")
def template_upsert(spark, d):
    b, none = brands(spark, d), F.lit(None).cast("string")
    more = b.where("stage = 'Sample'").select("alt_label", F.lit("").alias("definition"), F.lit("KiloGM").alias("unit"), F.lit("home:B2").alias("type"))
    new = table(spark, d, "nation").select(F.col("n_name").alias("alt_label"), none.alias("definition"), none.alias("unit"), none.alias("type"))
    return template.upsert(b, more.unionByName(new))


@query(f"""WITH b AS ({BRANDS}) SELECT {_FIELDS.replace("unit,", "CASE WHEN alt_label = 'Brand#1' THEN 'GM' ELSE unit END AS unit,")} FROM b WHERE alt_label <> 'Brand#2' UNION ALL SELECT CAST(max(ordinal) + 1 AS INTEGER), 'c', 'home:C', '{NO_DEFINITION}', 'UNITLESS', 'UNKNOWN', '' FROM b""")
def template_changes(spark, d):
    t, new = template.add_column(checkpoint(brands(spark, d)), "c", "home:C")
    t, again = template.add_column(t, "Brand#3", "home:Other")
    assert new and not again
    return template.delete_column(template.update(t, "Brand#1", "unit", "GM"), "Brand#2")


@query(f"""WITH b AS ({BRANDS}), c AS (SELECT DISTINCT p_brand FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0)
SELECT 'undefined_column' AS "check", n_name AS label, '' AS detail FROM nation UNION ALL SELECT 'empty_entry', alt_label, '' FROM b WHERE alt_label NOT IN (SELECT p_brand FROM c) UNION ALL SELECT 'missing_field', alt_label, 'definition' FROM b WHERE stage = 'Sample'""")
def alignment_audit(spark, d):
    b = brands(spark, d).withColumn("definition", F.when(F.col("stage") == "Sample", NO_DEFINITION).otherwise(F.col("definition")))
    even = table(spark, d, "part").where("cast(substr(p_brand, 7) as int) % 2 = 0").select(F.col("p_brand").alias("column"))
    columns = even.union(table(spark, d, "nation").select("n_name")).union(values(spark, "column string", ("__Label__",)))
    return template.audit(b, columns)


_KNOWN = "k AS (SELECT DISTINCT p_type AS name, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'Cheap' ELSE p_type || ' unit' END AS label, substr(p_type, 1, 2) AS ucum FROM part)"


@query(f"""WITH {_KNOWN}, c AS (SELECT 'unit:' || n_name AS cell FROM nation UNION SELECT '{{''@id'': ''unit:' || n_name || '''}}' FROM nation UNION SELECT unnest([lower(name), lower(label), ucum, lower(ucum), name || '?']) FROM k),
m AS (SELECT cell, count(DISTINCT name) AS n, min(name) AS name FROM c JOIN k ON NOT contains(cell, ':') AND (lower(cell) = lower(name) OR lower(cell) = lower(label) OR cell = ucum) GROUP BY cell)
SELECT c.cell, CASE WHEN contains(c.cell, ':') THEN regexp_extract(c.cell, 'unit:(\\w+)', 1) WHEN n = 1 THEN name ELSE 'UNITLESS' END AS unit, CAST(coalesce(n, 0) AS INTEGER) AS n FROM c LEFT JOIN m ON m.cell = c.cell""")
def unit_cell_parse(spark, d):
    """Cells of prefixed names, dicts, names, labels that two units share, codes in the right and the wrong case, and none."""
    label = F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "Cheap").otherwise(F.concat("p_type", F.lit(" unit")))
    known = table(spark, d, "part").select(F.col("p_type").alias("name"), label.alias("label"), F.substring("p_type", 1, 2).alias("ucum_code")).distinct()
    n = table(spark, d, "nation")
    cells = n.select(F.explode(F.array(F.concat(F.lit("unit:"), "n_name"), F.concat(F.lit("{'@id': 'unit:"), "n_name", F.lit("'}")))).alias("unit"))
    cells = cells.union(known.select(F.explode(F.array(F.lower("name"), F.lower("label"), "ucum_code", F.lower("ucum_code"), F.concat("name", F.lit("?"))))))
    return template.unit_lookup(cells, known).select("cell", "unit", F.size("candidates").alias("n"))


# --- ontologies: a class a nation below its region's; a property a region to the next ones


def _onto(spark, d) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    t, iri = serialize.triple, lambda kind, c: F.concat(F.lit(HOME + kind), c.cast("string"))
    key, up, own = F.col("n_nationkey"), F.col("n_regionkey"), F.col("r_regionkey")
    later = lambda k: iri("r", (own + k) % 5)
    nations = serialize.emit(n, None, [t(iri("n", key), f"{RDF}type", F.lit(f"{OWL}Class"), "iri"), t(iri("n", key), f"{RDFS}subClassOf", iri("r", up), "iri"), t(iri("n", key), f"{SKOS}altLabel", F.col("n_name")), t(iri("n", key), f"{RDFS}label", F.concat(F.lit("A "), "n_name"))])
    odd, even = F.expr("r_regionkey % 2 = 1"), F.expr("r_regionkey % 2 = 0")
    node = lambda k: F.concat(F.lit(f"_:{k}"), own.cast("string"))
    name = F.concat(F.lit("p"), own.cast("string"))
    regions = serialize.emit(r, None, [
        t(later(0), f"{RDF}type", F.lit(f"{OWL}Class"), "iri"), t(later(0), f"{SKOS}altLabel", F.col("r_name")),
        t(iri("obj", own), f"{RDF}type", F.lit(f"{OWL}ObjectProperty"), "iri"), t(iri("obj", own), f"{RDFS}label", name), t(iri("obj", own), f"{RDFS}domain", later(0), "iri"),
        t(iri("obj", own), f"{RDFS}range", F.when(even, later(1)), "iri"), t(iri("obj", own), f"{RDFS}range", F.when(odd, node("u")), "bnode"),
        t(node("u"), f"{OWL}unionOf", F.when(odd, node("a")), "bnode"), t(node("a"), f"{RDF}first", F.when(odd, later(1)), "iri"), t(node("a"), f"{RDF}rest", F.when(odd, node("b")), "bnode"),
        t(node("b"), f"{RDF}first", F.when(odd, later(2)), "iri"), t(node("b"), f"{RDF}rest", F.when(odd, F.lit(f"{RDF}nil")), "iri"),
        t(iri("dat", own), f"{RDF}type", F.when(odd, F.lit(f"{OWL}DatatypeProperty")), "iri"), t(iri("dat", own), f"{RDFS}label", F.when(odd, name)), t(iri("dat", own), f"{RDFS}domain", F.when(odd, later(0)), "iri"),
    ])
    return nations.unionByName(regions).where("o is not null")


@query(f"SELECT 'p' || r_regionkey AS label, CASE WHEN r_regionkey % 2 = 1 THEN '{HOME}dat' ELSE '{HOME}obj' END || r_regionkey AS iri, CASE WHEN r_regionkey % 2 = 1 THEN 'datatype' ELSE 'object' END AS kind FROM region")
def relation_kind_clash(spark, d):
    return ontology.properties(_onto(spark, d))


@query(f"""SELECT 'p' || r_regionkey AS property, CASE WHEN r_regionkey % 2 = 1 THEN '{HOME}dat' ELSE '{HOME}obj' END || r_regionkey AS iri, CASE WHEN r_regionkey % 2 = 1 THEN 'datatype' ELSE 'object' END AS kind FROM region
UNION ALL SELECT 'http://x.y/' || n_nationkey, 'http://x.y/' || n_nationkey, NULL FROM nation UNION ALL SELECT 'none' || n_nationkey, NULL, NULL FROM nation UNION ALL SELECT 'home:obj' || r_regionkey, '{HOME}obj' || r_regionkey, 'object' FROM region WHERE r_regionkey % 2 = 0""")
def relation_resolve(spark, d):
    """By label, by prefixed name, as an IRI, or not at all."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    made = lambda df, text, c: df.select(F.concat(F.lit(text), F.col(c).cast("string")).alias("property"))
    keys = made(r, "p", "r_regionkey").union(made(n, "http://x.y/", "n_nationkey")).union(made(n, "none", "n_nationkey")).union(made(r.where("r_regionkey % 2 = 0"), "home:obj", "r_regionkey"))
    return relations.resolve(keys, ontology.properties(_onto(spark, d)))


@query(f"SELECT '{HOME}obj' || a.n_regionkey AS prop, a.n_name AS subject, b.n_name AS object FROM nation a JOIN nation b ON b.n_regionkey = (a.n_regionkey + 1) % 5 OR (a.n_regionkey % 2 = 1 AND b.n_regionkey = (a.n_regionkey + 2) % 5)")
def relation_discovery(spark, d):
    columns = table(spark, d, "nation").select(F.col("n_name").alias("column"), F.concat(F.lit(f"{HOME}n"), F.col("n_nationkey").cast("string")).alias("iri"))
    return relations.discover(_onto(spark, d), columns)


def _pairs(spark, d) -> DataFrame:
    """A relation a nation, to its region; those of region 3 aren't resolved."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    key = F.col("r_regionkey").cast("string")
    return n.select(F.concat(F.lit("p"), key).alias("property"), F.when(F.col("r_regionkey") != 3, F.concat(F.lit(f"{HOME}obj"), key)).alias("iri"), F.when(F.col("r_regionkey") != 3, "object").alias("kind"), F.col("n_name").alias("subject"), F.col("r_name").alias("object"))


@query("""WITH x AS (SELECT 'p' || r_regionkey AS property, n_name AS subject, r_name AS object, n_nationkey AS n FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'unresolved_property' AS "check", 'p3' AS property, NULL::VARCHAR AS subject, NULL::VARCHAR AS object WHERE EXISTS (SELECT 1 FROM x WHERE property = 'p3') UNION ALL SELECT 'missing_subject_column', property, subject, object FROM x WHERE n % 2 = 1 UNION ALL SELECT 'missing_object_column', property, subject, object FROM x WHERE object = 'ASIA'""")
def relation_validate(spark, d):
    """Of a table with columns for every second nation and every region but one."""
    columns = [r["n_name"] for r in table(spark, d, "nation").where("n_nationkey % 2 = 0").collect()] + [r["r_name"] for r in table(spark, d, "region").where("r_name <> 'ASIA'").collect()]
    return relations.validate(_pairs(spark, d), columns)


@query(f"SELECT 'p' || r_regionkey AS property, n_name AS subject, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey NOT IN (0, 2) AND NOT (r_regionkey = 1 AND n_nationkey % 2 = 0) AND '{HOME}' <> ''")
def relation_changes(spark, d):
    """Added twice, then some pairs deleted by key, one property by IRI and one by prefixed name."""
    p = checkpoint(_pairs(spark, d))
    some = [(r["subject"], r["object"]) for r in p.where("property = 'p1' and cast(regexp_extract(subject, '([0-9]+)$', 1) as int) % 2 = 0").collect()]
    p = relations.delete(relations.add(p, p), "p1", some)
    return relations.delete(relations.delete(p, f"{HOME}obj2"), "home:obj0").select("property", "subject", "object")


@query(f"SELECT '{HOME}n' || n_nationkey AS iri, n_name AS label, CAST(0 AS INTEGER) AS rank FROM nation UNION ALL SELECT '{HOME}n' || n_nationkey, 'A ' || n_name, 1 FROM nation UNION ALL SELECT '{HOME}r' || r_regionkey, r_name, 0 FROM region")
def term_extraction(spark, d):
    return ontology.terms(_onto(spark, d)).select("iri", "label", "rank")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'en ' ELSE 'de ' END || n_name AS label, CASE WHEN n_regionkey = 0 THEN 'c' || n_nationkey END AS ucum_code FROM nation")
def unit_table(spark, d):
    """Units with labels in two languages, of which English counts, or in one."""
    n, t, at = table(spark, d, "nation"), serialize.triple, F.concat(F.lit("urn:u/"), "n_name")
    kind = F.when(F.col("n_nationkey") % 3 == 0, f"{ontology.QUDT_SCHEMA}DerivedUnit").otherwise(f"{ontology.QUDT_SCHEMA}Unit")
    said = serialize.emit(n, None, [t(at, f"{RDF}type", kind, "iri"), t(at, f"{ontology.QUDT_SCHEMA}ucumCode", F.when(F.col("n_regionkey") == 0, F.concat(F.lit("c"), F.col("n_nationkey").cast("string"))))]).where("o is not null")
    label = lambda lang: serialize.emit(n if lang == "de" else n.where("n_nationkey % 2 = 0"), None, [t(at, f"{RDFS}label", F.concat(F.lit(lang + " "), "n_name"))]).withColumn("o_lang", F.lit(lang))
    return ontology.units(said.unionByName(label("de")).unionByName(label("en"))).select("name", "label", "ucum_code")


_TREE = "e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 'r' || r_regionkey, 'world' FROM region)"


@query(f"WITH {_TREE} SELECT DISTINCT 'urn:' || parent AS iri FROM e WHERE parent NOT IN (SELECT child FROM e)")
def top_categories(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    iri = lambda text, c: F.concat(F.lit(text), F.col(c).cast("string"))
    edges = serialize.emit(n, None, [serialize.triple(iri("urn:n", "n_nationkey"), f"{SKOS}broader", iri("urn:r", "n_regionkey"), "iri")])
    return ontology.top_categories(edges.unionByName(serialize.emit(r, None, [serialize.triple(iri("urn:r", "r_regionkey"), f"{SKOS}broader", F.lit("urn:world"), "iri")])))


@query("SELECT DISTINCT 'urn:c' || c_custkey AS iri FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'NATION_1'")
def semi_filter(spark, d):
    """Customers of a nation, which is given by its label in other case."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    iri = lambda text, k: F.concat(F.lit(text), F.col(k).cast("string"))
    t = serialize.emit(c, None, [serialize.triple(iri("urn:c", "c_custkey"), f"{HOME}inDomain", iri("urn:n", "c_nationkey"), "iri")])
    named = serialize.emit(n, None, [serialize.triple(iri("urn:n", "n_nationkey"), f"{RDFS}label", F.col("n_name"))])
    return ontology.term_filter(t.unionByName(named), "nation_1")


@query("WITH e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer WHERE c_nationkey % 3 = 0 UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation) SELECT DISTINCT 'urn:' || child AS iri FROM e WHERE child NOT IN (SELECT parent FROM e)")
def anti_orphans(spark, d):
    """Classes that nothing is below: customers, and nations without any."""
    c, n = table(spark, d, "customer").where("c_nationkey % 3 = 0"), table(spark, d, "nation")
    iri = lambda text, k: F.concat(F.lit(text), F.col(k).cast("string"))
    t = serialize.emit(c, None, [serialize.triple(iri("urn:c", "c_custkey"), f"{RDFS}subClassOf", iri("urn:n", "c_nationkey"), "iri")])
    return ontology.leaf_classes(t.unionByName(serialize.emit(n, None, [serialize.triple(iri("urn:n", "n_nationkey"), f"{RDFS}subClassOf", iri("urn:r", "n_regionkey"), "iri")])))


@query("SELECT 'urn:e' || event_id AS s, 'urn:k' AS p, props ->> '$.k' AS o FROM events")
def json_value(spark, d):
    """The JSON of each event as a JSON-LD document."""
    doc = F.concat(F.lit('{"@context": {"k": "urn:k"}, "@id": "urn:e'), F.col("event_id").cast("string"), F.lit('", '), F.substr("props", F.lit(2)))
    return rdf.parse_column(table(spark, d, "events").select("event_id", doc.alias("doc")), "event_id", "doc").select("s", "p", "o")


# --- cubes


def _brand_variables(spark, d) -> list[Variable]:
    """A variable a brand; those of large parts are measures."""
    rows = brands(spark, d).orderBy("ordinal").collect()
    return [Variable("b" + r["alt_label"][6:], r["stage"] == "Sample", r["definition"], r["type"][5:], r["unit"] if r["stage"] == "Sample" else None) for r in rows]


@query(f"""WITH b AS ({BRANDS}) SELECT CASE WHEN stage = 'Sample' THEN 'measure' ELSE 'dimension' END AS kind, '{HOME}b' || substr(alt_label, 7) AS prop FROM b
UNION ALL SELECT 'dimension', '{QB}measureType' UNION ALL SELECT 'attribute', '{SDMX}attribute#unitMeasure' UNION ALL SELECT 'attribute', '{HOME}category'""")
def dsd_components(spark, d):
    bindings, ns = cube.namespaces({}, "home")
    v = _brand_variables(spark, d)
    dims, measures, _ = cube.split_variables(v, [x.name for x in v])
    t = cube.structure(spark, dims, measures, ns, bindings)
    return t.where(F.col("p").isin(f"{QB}dimension", f"{QB}measure", f"{QB}attribute")).select(S.fragment("p").alias("kind"), F.col("o").alias("prop"))


@query(f"WITH b AS ({BRANDS}) SELECT 'b' || substr(alt_label, 7) AS name, stage = 'Sample' AS is_measure, definition AS alt_label, substr(type, 6) AS category, CASE WHEN stage = 'Sample' THEN '{HOME}' || unit ELSE '' END AS units FROM b")
def cube_variables(spark, d):
    """The variables of a cube of brands by type, as its triples describe them."""
    v = _brand_variables(spark, d)
    p = table(spark, d, "part").groupBy(F.col("p_type").alias("kind")).pivot("p_brand", ["Brand#" + x.name[1:] for x in v]).agg(F.count("p_partkey"))
    p = p.toDF("kind", *[x.name for x in v])
    t = checkpoint(cube.cube_triples(p, v, name="brands", orcid=ORCID, stamp="T", row="kind"))
    return cube.read_variables(t).withColumn("units", F.array_join("units", ",")).select("name", "is_measure", "alt_label", "category", "units")


@query(f"""WITH o AS (SELECT *, '{HOME}observation_0000000123456789_T_' || o_orderkey || '_1' AS obs FROM orders) SELECT o_orderstatus, o_orderpriority, max_by(o_totalprice, row(length(obs), obs)) AS o_totalprice FROM o GROUP BY ALL""")
def cube_last_value(spark, d):
    """Of many observations of equal dimensions the last one counts."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    v = [Variable("o_orderstatus"), Variable("o_orderpriority"), Variable("o_totalprice", True)]
    return cube.cube_table(stored(cube.cube_triples(o, v, name="orders", orcid=ORCID, stamp="T", row="o_orderkey")))


@query("""WITH c AS (SELECT CAST(100 - n_nationkey AS VARCHAR) AS "ExperimentId", n_nationkey * 1.0::DOUBLE AS v FROM nation) SELECT row_number() OVER (ORDER BY CAST("ExperimentId" AS DOUBLE)) - 1 AS place, "ExperimentId", v FROM c""")
def cube_order(spark, d):
    """Rows that are read back go by ExperimentId."""
    n = table(spark, d, "nation").select((100 - F.col("n_nationkey")).cast("string").alias("ExperimentId"), F.col("n_nationkey").cast("double").alias("v"))
    t = checkpoint(cube.cube_triples(n, [Variable("ExperimentId"), Variable("v", True)], name="n", orcid=ORCID, stamp="T", row="ExperimentId"))
    rows = [(i, r["ExperimentId"], r["v"]) for i, r in enumerate(cube.cube_table(t).collect())]
    return values(spark, "place bigint, ExperimentId string, v double", *rows)
