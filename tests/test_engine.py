import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from semloom import functions as S
from semloom.frame import SemanticFrame, rdf_to_tables
from semloom.operators import cube, ontology, reconstruct, relations, serialize, template
from semloom.operators.cube import Variable
from semloom.operators.serialize import Entry, Relation
from semloom.session import numbered
from semloom.sources import rdf, tables
from semloom.terms import DCT, ENTITY_IRI, HOME, LICENSES_AT, OWL, QB, QUDT, RDF, RDFS, SKOS, XSD

ORCID = "0000-0001-2345-6789"
DDL = "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string"


def col(spark, expr, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(expr(F.col("v")).alias("r")).collect()
    return [r.r for r in rows]


# --- scalar functions


def test_hash6(spark):
    import hashlib

    values = ["", "a", "é漢", "x" * 1000]
    want = [int(hashlib.sha256(v.encode()).hexdigest(), 16) % 900_000 + 100_000 for v in values]
    assert col(spark, S.hash6, *values, None) == [*want, None]
    assert want[0] == 386549


def test_names(spark):
    assert col(spark, S.normalize, "Young's Modulus (GPa)", "a-b/c_d.e:f") == ["youngs_modulus_gpa", "abc_d.e:f"]
    assert col(spark, S.normalize_iri, "A b/C") == ["a_b/c"]
    assert col(spark, S.normalize_strict, "A-b 1_é") == ["ab1"]
    assert col(spark, S.sanitize_iri, "1 a--b ", "é ü", "__x__") == ["1_a_b", "é_ü", "x"]
    assert col(spark, S.dataset_name, "1 a") == ["_1_a"]
    assert col(spark, S.local_name, "http://x/y#z", "urn:x#z", "plain") == ["y#z", "z", "plain"]
    assert col(spark, S.fragment, "http://x/y#z", "urn:x#z") == ["z", "z"]
    assert col(spark, S.percent_encode, "a b/é~*+") == ["a%20b%2F%C3%A9~%2A%2B"]
    assert col(spark, lambda c: S.license_iri(c, ["MIT"]), None, "http://x", "MIT") == [f"{LICENSES_AT}CC0-1.0.html", "http://x", f"{LICENSES_AT}MIT.html"]
    with pytest.raises(Exception, match="unknown licence"):
        col(spark, lambda c: S.license_iri(c, ["MIT"]), "NOPE")
    assert col(spark, S.is_blank, None, " ", "NaN", "x") == [True, True, True, False]


def test_near_match(spark):
    assert col(spark, lambda c: S.near_match(c, "hardness"), "Vickers-Hardnes", "hard_ness", "softness") == [True, False, False]
    assert col(spark, lambda c: S.near_match(c, "ab", 2), "zz", "") == [True, False]


def test_numbered(spark):
    df = spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1000).repartition(6)
    rows = numbered(df, ["k"], "n").collect()
    assert all(r.n == r.k + 1 for r in rows) and len(rows) == 1000


# --- tables to triples and back

TEMPLATE = [Entry("Sample", "home:Sample", "a sample", "UNITLESS", "Sample"), Entry("Load", "home:Load", "a load", "N", "Result"), Entry("Note", "home:Note", "a note", "UNITLESS", "")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([("s1", 1.5, "x"), ("s2", None, " "), ("s3", float("nan"), None)], "Sample string, Load double, Note string")


def test_values_and_constants(table):
    t = serialize.table_triples(table, TEMPLATE, orcid=ORCID, verified=False)
    rows = t.collect()
    value = [r.o for r in rows if r.p == f"{QUDT}value"]
    assert sorted(value) == ["1.5", "s1", "s2", "s3", "x"]  # neither null, NaN nor blank cells have values
    assert sum(r.p == f"{DCT}creator" for r in rows) == 9  # but all their entities have the rest
    assert sum(r.o == serialize.UNVERIFIED for r in rows) == 9
    g = {r.g for r in rows}
    assert len(g) == 3 and all("-or0000000123456789" in x for x in g)


def test_round_trip(table):
    back = reconstruct.wide(reconstruct.entities(serialize.table_triples(table, TEMPLATE, orcid=ORCID)), source=None)
    assert sorted(map(tuple, back.select("Sample", "Load", "Note").collect())) == [("s1", "1.5", "x"), ("s2", None, None), ("s3", None, None)]


def test_missing_template_column_is_null(table):
    """A row isn't lost over a column that the table lacks."""
    t = serialize.table_triples(table, [*TEMPLATE, Entry("Gone", "home:Gone")], orcid=ORCID)
    assert reconstruct.wide(reconstruct.entities(t)).select("Gone").distinct().collect() == [(None,)]


def test_key_columns_in_the_given_order(table):
    t = serialize.table_triples(table, TEMPLATE, orcid=ORCID, key_columns=["Note", "nope", "Sample"])
    assert f"{HOME}Sample.x-s1" in {r.s for r in t.collect()}


def test_id_columns_relations_and_labels(spark):
    df = spark.createDataFrame([("A 1", "B/é", 3, True), (None, "C", 4, None)], "a string, b string, n int, f boolean")
    tpl = [Entry("a", "home:A"), Entry("b", "home:B")]
    rel = [Relation("home:to", "object", "a", "b"), Relation("home:free", "object", "a", "n"), Relation("home:size", "datatype", "b", "n"), Relation("home:flag", "datatype", "b", "f"), Relation("home:no", None, "a", "b")]
    rows = serialize.table_triples(df, tpl, orcid=ORCID, id_columns=["a", "b"], relations=rel, label_pairs=[("a", "b")]).collect()
    got = {(r.s.removeprefix(HOME), r.p, r.o.removeprefix(HOME), r.o_dt) for r in rows}
    assert ("A.a1", f"{HOME}to", "B.b", None) in got and ("A.a1", f"{HOME}free", "3", None) in got
    assert ("B.b", f"{HOME}size", "3", f"{XSD}integer") in got and ("B.b", f"{HOME}flag", "true", f"{XSD}boolean") in got
    assert ("B.c", f"{HOME}size", "4", f"{XSD}integer") in got and ("A.a1", f"{RDFS}label", "B/é", None) in got
    assert not any(p in (f"{HOME}no",) or (s == "B.c" and p == f"{HOME}flag") for s, p, *_ in got)
    assert not any(s.startswith("A.") and s != "A.a1" for s, *_ in got)


def test_firewall(table, spark):
    t = serialize.table_triples(table, TEMPLATE, orcid=ORCID, classes=[f"{HOME}Sample"])
    assert {r.o for r in t.where(F.col("p") == f"{RDF}type").collect()} == {f"{HOME}Sample", ENTITY_IRI}
    loose = spark.createDataFrame([("g", "s", f"{RDF}type", x, "iri", None, None) for x in ("k:1", "k:2")] + [("g", "t", f"{RDF}type", "k:1", "iri", None, None)], DDL)
    got = {(r.s, r.o) for r in serialize.firewall(loose, spark.createDataFrame([("k:1",)], "iri string")).collect()}
    assert got == {("s", ENTITY_IRI), ("t", "k:1")}


def test_serialisation_is_narrow(table):
    plan = serialize.table_triples(table, TEMPLATE, orcid=ORCID)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "Python" not in plan


def test_last_value_and_conflicts(spark):
    rows = [(g, s, p, o, "lit", None, None) for g, s, label, unit, v in (("f1", "a", "x", "u:1", "1"), ("f1", "b", "x", "u:2", "2"), ("f2", "a", "x", "u:1", "3")) for p, o in ((f"{SKOS}altLabel", label), (f"{QUDT}hasUnit", unit), (f"{QUDT}value", v), (f"{RDF}type", "home:X"))]
    found = reconstruct.entities(spark.createDataFrame(rows, DDL))
    assert {r["__source_file__"]: r.x for r in reconstruct.wide(found).collect()} == {"f1": "2", "f2": "3"}
    c = reconstruct.conflicts(found).collect()
    assert [(r.g, r.kind, r.expected, r.found, r.expected_from) for r in c] == [("f1", "unit", "u:1", "u:2", "f1")]
    assert "1 conflicts" in reconstruct.report(reconstruct.conflicts(found))


def test_full_and_short_types_agree(spark):
    """A template's prefix:rest is expanded before types are compared."""
    t = spark.createDataFrame([("f", "a", f"{SKOS}altLabel", "x", "lit", None, None), ("f", "a", f"{RDF}type", f"{HOME}X", "iri", None, None)], DDL)
    assert reconstruct.conflicts(reconstruct.entities(t), [Entry("x", "home:X")]).count() == 0


# --- templates


def test_fuzzy_is_difflib():
    words = ["young_modulus", "youngs_modulus", "hardness", "load", "loads", "region_measured"]
    keys = ["youngs_moduls", "hardnes", "lod", "zzz", "", "regionmeasured"]
    for key, (got, ratio) in zip(keys, template.best_ratio(keys, words), strict=True):
        scored = [(SequenceMatcher(None, w, key).ratio(), w) for w in words]
        best = max((x for x in scored if x[0] >= 0.8), default=None)
        assert (got, ratio) == ((best[1], best[0]) if best else (None, None))


def onto_rows():
    cls = [("T:Load", "Load", "Sample"), ("T:Hardness", "Vickers Hardness", "Result"), ("T:Metal", "Metal", None), ("T:Sample", "Sample", None)]
    rows = [(None, f"{HOME}{c[2:]}", f"{RDF}type", f"{OWL}Class", "iri", None, None) for c, *_ in cls]
    rows += [(None, f"{HOME}{c[2:]}", f"{SKOS}altLabel", label, "lit", None, None) for c, label, _ in cls]
    rows += [(None, f"{HOME}{c[2:]}", f"{SKOS}definition", f"def {label}", "lit", None, None) for c, label, _ in cls]
    rows += [(None, f"{HOME}{c[2:]}", f"{HOME}hasStudyStage", s, "lit", None, None) for c, _, s in cls if s]
    prop = f"{HOME}ofSample"
    rows += [(None, prop, f"{RDF}type", f"{OWL}ObjectProperty", "iri", None, None), (None, prop, f"{RDFS}label", "of sample", "lit", None, None), (None, prop, f"{RDFS}domain", f"{HOME}Quantity", "iri", None, None), (None, prop, f"{RDFS}range", f"{HOME}Sample", "iri", None, None)]
    return rows + [(None, f"{HOME}Load", f"{RDFS}subClassOf", f"{HOME}Quantity", "iri", None, None)]


@pytest.fixture(scope="module")
def onto(spark):
    return spark.createDataFrame(onto_rows(), DDL).cache()


def test_generation(spark, onto):
    header = spark.createDataFrame([(0, "Load", None, "newton", None), (1, "Vickers Hardnes", None, None, None), (2, "Other Thing", None, "unit:KiloGM", None), (3, "Given", "obo:X", "x", "Recipe"), (4, "__rowkey__", None, None, None)], "ordinal int, column string, type string, unit string, stage string")
    units = spark.createDataFrame([("N", "Newton", "N")], "name string, label string, ucum_code string")
    made, matched, unmatched = template.generate(header, ontology.terms(onto), units)
    e = {x.alt_label: x for x in template.entries(made)}
    assert (e["Load"].type, e["Load"].definition, e["Load"].unit, e["Load"].stage) == ("home:Load", "def Load", "N", "Sample")
    assert e["Vickers Hardnes"].type == "home:Hardness" and e["Vickers Hardnes"].stage == "Result"
    assert (e["Other Thing"].type, e["Other Thing"].unit, e["Other Thing"].definition) == ("home:other_thing", "KiloGM", "Definition not available")
    assert (e["Given"].type, e["Given"].unit, e["Given"].stage) == ("obo:X", "UNITLESS", "Recipe")
    assert {r.line for r in matched.collect()} == {"Load => Load", "Vickers Hardnes => Hardness"}
    assert {r.line for r in unmatched.collect()} == {"Other Thing", "Given"} and len(e) == 4


def test_template_documents():
    back = template.from_jsonld(json.loads(json.dumps(template.to_jsonld(TEMPLATE))))
    assert [(e.alt_label, e.type, e.definition, e.unit, e.stage) for e in back] == [(e.alt_label, e.type, e.definition, e.unit, e.stage) for e in TEMPLATE]
    assert template.from_jsonld({"@type": "home:A", "skos:altLabel": "a"})[0].alt_label == "a"
    assert [e.alt_label for e in template.from_jsonld([{"@type": "home:A", "skos:altLabel": "a"}])] == ["a"]


def test_adding_a_known_column_says_so(spark):
    t = template.frame(spark, TEMPLATE)
    assert template.add_column(t, "Load", "home:L")[1] is False and template.add_column(t, "New", "home:N")[1] is True
    with pytest.raises(ValueError, match="no field"):
        template.update(t, "Load", "colour", "red")


# --- relations and hierarchies


def test_relation_table(spark, onto):
    keys = relations.resolve(relations.frame(spark, {"of sample": [("Load", "Sample")], "odd": [("Load", "X")]}), ontology.properties(onto))
    assert {(r.property, r.iri, r.kind) for r in keys.collect()} == {("of sample", f"{HOME}ofSample", "object"), ("odd", None, None)}
    r = relations.delete(keys.select("property", "iri", "kind", "subject", "object"), "home:ofSample")
    assert [x.property for x in r.collect()] == ["odd"]
    assert "odd (unresolved)" in relations.text(r) and {x.check for x in relations.validate(r, ["Load"]).collect()} == {"unresolved_property", "missing_object_column"}


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), (None, "x")], "child string, parent string")
    got = {(r.child, r.ancestor): r.depth for r in ontology.closure(e).collect()}
    assert got["d", "c"] == 3 and got["a", "a"] == 0 and len(got) == 13
    assert ontology.root_domains(e).count() == 4  # no endless climb, either


def test_filters_and_subset(spark, onto, tmp_path):
    assert {r.iri for r in ontology.term_filter(onto, "result", ["stage"]).collect()} == {f"{HOME}Hardness"}
    assert ontology.term_filter(onto, None).count() == 2
    s = ontology.subset(onto, ontology.term_filter(onto, "RESULT", ["stage"]))
    assert s.select("s").distinct().count() == 1 and s.count() == 4
    hits = ontology.fuzzy_search(ontology.catalogue(onto), ["hardnes", "load"]).collect()
    assert {(r.subject_id, r.keyword) for r in hits} == {(f"{HOME}Hardness", "hardnes"), (f"{HOME}Load", "load")}


def test_classification(spark):
    low = spark.createDataFrame([(None, "n:a", f"{RDFS}subClassOf", "n:b", "iri", None, None), (None, "n:c", f"{RDFS}subClassOf", "n:b", "iri", None, None), (None, "n:z", f"{RDFS}subClassOf", "n:y", "iri", None, None)], DDL)
    more = spark.createDataFrame([(None, "n:b", f"{SKOS}broader", "n:top", "iri", None, None), (None, "n:top2", f"{SKOS}broader", "n:top", "iri", None, None), (None, "n:b", f"{RDFS}subClassOf", "n:a", "iri", None, None)], DDL)
    got = {r.term: r.category for r in ontology.classification(low, low.union(more)).collect()}
    assert got == {"n:a": "n:top", "n:c": "n:top", "n:z": None}
    assert list(ontology.category_colours([str(i) for i in range(11)]).values())[10] == ontology.PALETTE[0]


# --- cubes

VARS = [Variable("ExperimentId"), Variable("Batch", alt_label="batch", category="Sample facts"), Variable("Hard", True, "hardness", "Result", "unit:GPa"), Variable("Note", True)]


@pytest.fixture(scope="module")
def cube_df(spark):
    return spark.createDataFrame([(1, "b1", 1.5, "ok"), (2, None, 2.5, None), (3, "b3", None, "12")], "ExperimentId int, Batch string, Hard double, Note string")


@pytest.mark.parametrize("options", [{}, {"fixed": ["ExperimentId"]}, {"global_numbers": True}, {"mode": "rows"}])
def test_cube_round_trip(cube_df, options):
    t = cube.cube_triples(cube_df, VARS, id_columns=["ExperimentId"], orcid=ORCID, stamp="T", row="ExperimentId", given={"unit": "http://u.org/unit"}, **options)
    back = cube.cube_table(t)
    assert sorted(map(tuple, back.select("ExperimentId", "Batch", "Hard", "Note").collect())) == [("1", "b1", 1.5, "ok"), ("2", None, 2.5, None), ("3", "b3", None, "12.0")]
    v = {r.name: r for r in cube.read_variables(t).collect()}
    assert v["Hard"].units == ["http://u.org/unit#GPa"] and v["Batch"].category == "Sample_facts" and not v["Batch"].is_measure
    assert t.where(F.col("o") == f"{QB}Slice").count() == 3
    obs = cube.observations_of(t)
    assert obs.count() == 4 and obs.select("obs").distinct().count() == 4  # observations of different rows never share a name


def test_cube_checks(cube_df):
    with pytest.raises(ValueError, match="http"):
        cube.namespaces({"x": "ftp://x"}, "x")
    assert cube.namespaces({"X ": "http://x"}, "x")[1] == "http://x#"
    with pytest.raises(ValueError, match="prefix"):
        cube.property_of(Variable("a", existing="zz:a"), HOME, {})
    assert cube.property_of(Variable("a", existing="https://x.org/a"), HOME, {}) == "https://x.org/a"
    with pytest.raises(ValueError, match="mode"):
        cube.cube_triples(cube_df, VARS, mode="odd")
    dims, measures, unknown = cube.split_variables(VARS, [*cube_df.columns, "Extra"])
    assert [d.name for d in dims] == ["ExperimentId", "Batch"] and len(measures) == 2 and unknown == ["Extra"]
    assert cube.id_candidates(["Width", "Id", "x"]) == ["Width", "Id"]


def test_flat_cube(cube_df):
    t = cube.cube_triples(cube_df, VARS, mode="flat", id_columns=["ExperimentId"], orcid=ORCID, stamp="T", given={"unit": "http://u.org/unit"})
    rows = t.collect()
    import re

    assert all(re.fullmatch(rf"{re.escape(HOME)}[a-z]-[123]-0000000123456789-T", r.g) for r in rows)
    assert {r.o_dt for r in rows if r.p == f"{QUDT}value" and "/Hard-" in r.s} == {f"{XSD}float"}


# --- tables, frames, command line


def write_csv(path):
    path.write_text("Sample,Load\nhome:Sample,home:Load\n,unit:N\nSample,Result\n007,1.50\n008,\n")
    return str(path)


def test_csv_with_header_rows(spark, tmp_path):
    df, header = tables.read_csv(spark, write_csv(tmp_path / "t.csv"), True)
    assert [tuple(r) for r in df.orderBy(tables.ROW).collect()] == [("007", "1.50", 3), ("008", None, 4)]
    assert [tuple(r) for r in header.orderBy("ordinal").collect()] == [(0, "Sample", "home:Sample", None, "Sample"), (1, "Load", "home:Load", "unit:N", "Result")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "d/b.csv").write_text("x,z\n3,4\n")
    got = tables.read_csv_folder(spark, str(tmp_path / "d")).collect()
    assert {(r.x, r.y, r.z, r["__source_file__"]) for r in got} == {("1", "2", None, "a.csv"), ("3", None, "4", "b.csv")}


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "t.xlsx")
    tables.write_data_template(path, [Variable("A b", alt_label="a", category="C"), Variable("M", True, category="C", unit="u"), Variable("Empty")], [["x", 1.5, None], ["y", 2, None]])
    variables, df = tables.read_data_template(spark, path)
    assert [(v.name, v.is_measure, v.category) for v in variables] == [("A_b", False, "C"), ("M", True, "C"), ("Empty", False, None)]
    assert df.columns == ["ExperimentId", "A_b", "M"] and [tuple(r) for r in df.orderBy("ExperimentId").collect()] == [(1, "x", 1.5), (2, "y", 2.0)]
    names = str(tmp_path / "n.xlsx")
    tables.write_sheet(names, [["Prefix", "Namespace"], ["Ex", " http://ex.org/ "], ["b", "http://b/"], ["ex", "http://other/"], ["c", "http://c/"]])
    got, problem = tables.read_namespaces(names)
    assert got["ex"] == "http://ex.org/" and got["b"] == "http://b/" and "c" not in got and "ex" in problem
    tables.write_namespace_template(names)
    assert tables.read_namespaces(names)[1] is None


def test_save(spark, table, tmp_path):
    done = tables.save(table, str(tmp_path), "t")
    back = [spark.read.option("header", True).csv(done[0]), spark.read.parquet(done[1]), tables.read_arrow(spark, done[2])]
    assert all(b.columns == ["Load", "Note", "Sample"] and b.count() == 3 for b in back)
    assert back[1].where("Note is null").count() == 1  # nulls don't turn into text


def test_frame(spark, onto, tmp_path):
    f = SemanticFrame.from_csv(spark, write_csv(tmp_path / "t.csv"), True, onto=onto, orcid=ORCID)
    assert f.valid() and [(r.subject, r.object) for r in f.relations.collect()] == [("Load", "Sample")]
    f.serialize_rows(str(tmp_path / "rows"), "turtle", license="MIT")
    assert len(list((tmp_path / "rows").glob("*.ttl"))) == 3
    f.serialize_bulk(str(tmp_path / "all.jsonld"), "json-ld")
    f.serialize_bulk(str(tmp_path / "all_nt"))
    assert rdf.read(spark, str(tmp_path / "all.jsonld")).count() == rdf.read_ntriples(spark, str(tmp_path / "all_nt")).count()
    done = rdf_to_tables(spark, str(tmp_path / "rows"), str(tmp_path / "back"))
    csv = spark.read.option("header", True).csv(done[0]).collect()
    assert [r["__Label__"] for r in csv] == ["Type", "Units", "Study Stage", "1", "2"]
    assert {r.Sample for r in csv[3:]} == {"007", "008"} and csv[1].Load == "unit:N"
    assert "0 conflicts" in (tmp_path / "back/merged_output_report.txt").read_text()
    f.update("Load", "unit", "KN")
    f.update_bulk([Entry("More", "home:More")])
    f.delete_column("Sample")
    assert f.add_column("More", "home:M") is False and {e.alt_label: e.unit for e in f.entries()} == {"Load": "KN", "More": "UNITLESS"}
    assert {r.check for r in f.audit().collect()} == {"undefined_column", "empty_entry", "missing_field"} and not f.valid()
    f.add_relations({"of sample": [("Load", "Load")], "what": [("a", "b")]})
    assert f.validate_relations().count() == 3
    f.save_relations(str(tmp_path / "rel.json"))
    assert json.loads((tmp_path / "rel.json").read_text())["of sample"] == [["Load", "Load"]] and repr(f).endswith("3 relations)")
    with pytest.raises(ValueError, match="ORCID"):
        SemanticFrame(f.df, orcid="123")


def test_command_line(spark, onto, tmp_path, capsys):
    from semloom.cli import main

    rdf.write_document(onto, str(tmp_path / "onto.ttl"), "turtle")
    csv, o, run = write_csv(tmp_path / "t.csv"), str(tmp_path / "onto.ttl"), lambda *a: main(a, spark)
    run("filter", "--ontology", o, "--query", "result", "--turtle", str(tmp_path / "f.ttl"))
    assert f"{HOME}Hardness" in capsys.readouterr().out and rdf.read(spark, str(tmp_path / "f.ttl")).count() == 4
    run("view-domains", "--ontology", o)
    assert "└── " in capsys.readouterr().out
    run("search", "--ontology", o, "--keywords", "hardnes,zzzzzz")
    assert "Vickers Hardness" in capsys.readouterr().out
    run("add-term", "--ontology", o, "--out", str(tmp_path / "o2.ttl"), "--name", "home:New", "--label", "new", "--parent", "home:Load")
    assert rdf.read(spark, str(tmp_path / "o2.ttl")).where(F.col("s") == f"{HOME}New").count() == 3
    run("template", "--csv", csv, "--header-rows", "--ontology", o, "--out", str(tmp_path / "tpl.jsonld"))
    run("serialize", "--csv", csv, "--header-rows", "--ontology", o, "--template", str(tmp_path / "tpl.jsonld"), "--out", str(tmp_path / "rows"), "--key-columns", "Sample", "--relations", '{"of sample": [["Load", "Sample"]]}')
    assert len(list((tmp_path / "rows").iterdir())) == 2
    run("deserialize", "--folder", str(tmp_path / "rows"), "--out", str(tmp_path / "back"), "--formats", "csv,parquet")
    assert spark.read.parquet(str(tmp_path / "back/merged_output.parquet")).count() == 2
    tables.write_data_template(str(tmp_path / "c.xlsx"), [Variable("A"), Variable("M", True)], [["x", 1], ["y", 2]])
    run("cube", "--workbook", str(tmp_path / "c.xlsx"), "--out", str(tmp_path / "cube"), "--id-columns", "A")
    run("cube", "--read", str(tmp_path / "cube"), "--out", str(tmp_path / "cube_back"))
    assert {(r.A, r.M) for r in spark.read.parquet(str(tmp_path / "cube_back/dataset.parquet")).collect()} == {("x", "1.0"), ("y", "2.0")}


def test_streams(spark, tmp_path):
    from semloom import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("Sample,Load,Note\ns1,1.5,x\n")
    rows = streaming.stream_tables(spark, str(tmp_path / "in"), "Sample string, Load double, Note string")
    out = streaming.stream_triples(rows.withColumn("at", F.current_timestamp()).drop("at"), TEMPLATE, orcid=ORCID)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = serialize.table_triples(spark.read.schema(rows.schema).option("header", True).csv(str(tmp_path / "in")), TEMPLATE, orcid=ORCID)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))
    (tmp_path / "rdf").mkdir()
    (tmp_path / "rdf/a.ttl").write_text("<urn:a> <urn:p> 1 . <urn:a> <urn:p> 1 .")
    (tmp_path / "rdf/b.ttl").write_text("<urn:a> <urn:p> 1 .")
    triples = streaming.distinct_triples(streaming.stream_rdf(spark, str(tmp_path / "rdf")), "arrived")
    q = triples.writeStream.format("parquet").option("path", str(tmp_path / "out2")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 1


def test_walk_through_many_diamonds(spark):
    """2^14 ways from the leaf to the root, and a cycle on the way: each node is met once."""
    from semloom.operators import ontology
    from semloom.terms import RDFS

    edges = [(f"n{i}", f"{side}{i}") for i in range(14) for side in "ab"] + [(f"{side}{i}", f"n{i + 1}") for i in range(14) for side in "ab"] + [("n7", "a6"), ("n14", "top"), ("n3", "other"), ("lone", "nowhere")]
    rows = [(None, a, f"{RDFS}subClassOf", b, "iri", None, None) for a, b in edges]
    onto = spark.createDataFrame(rows, "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string")
    leaves, tops = (spark.createDataFrame([(x,) for x in names], "iri string") for names in (["n0", "lone", "top"], ["top", "other"]))
    got = {r.iri: r.top for r in ontology.classify_leaves(onto, leaves, tops).collect()}
    assert got == {"n0": "top", "lone": None, "top": "top"}


def test_closure_has_no_depth_bound(spark):
    from semloom.operators import ontology

    r = ontology.closure(spark.createDataFrame([(i, i + 1) for i in range(40)], "child int, parent int"))
    assert r.where("child = 0").agg({"depth": "max"}).first()[0] == 40


def test_rebuilding_shuffles_once_for_the_pivot(spark):
    from semloom.operators import reconstruct

    found = spark.createDataFrame([("g1", "s1", "a", "1"), ("g1", "s2", "b", "2"), ("g2", "s1", "a", "3")], "g string, s string, label string, value string")
    out = reconstruct.wide(found, ["a", "b"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(tuple(r) for r in out.collect()) == [("g1", "1", "2"), ("g2", "3", None)]


def test_rows_of_one_file_are_spread(spark, tmp_path):
    """However few parts a table has, its triples are made by all cores, each once."""
    spark.range(1000).selectExpr("cast(id as string) as Sample", "id * 0.5D as Load", "if(id % 2 = 0, 'x', null) as Note").coalesce(1).write.parquet(str(tmp_path / "t"))
    t = serialize.table_triples(spark.read.parquet(str(tmp_path / "t")), TEMPLATE, orcid=ORCID)
    busy = t.groupBy(F.spark_partition_id()).count().collect()
    assert len(busy) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in busy) == 3000 * 9 + 2500


def test_definitions_gather_only_labels(spark):
    """Definitions straight from triples are those of the entities, and what is shuffled of all subjects is their labels."""
    rows = [(g, s, p, o, "lit", None, None) for g, s, label, unit in (("f1", "b", "x", "u:1"), ("f1", "a", "y", "u:2"), (None, "z", "y", "u:3"), ("f0", "c", "x", None), ("f0", "c", "w", None)) for p, o in ((f"{SKOS}altLabel", label), (f"{QUDT}hasUnit", unit), (f"{RDF}type", f"home:{s}")) if o]
    t = spark.createDataFrame(rows, DDL)
    want = reconstruct.first_definitions(reconstruct.entities(t))
    got = reconstruct.definitions_of(t)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and plan.index("LeftSemi") > plan.index("Exchange hashpartitioning")  # subjects are chosen before they are gathered


def test_cube_table_joins_once(cube_df):
    """What is said of an observation meets in one aggregation; only slices are joined."""
    t = cube.cube_triples(cube_df, [cube.Variable(c, i > 0) for i, c in enumerate(cube_df.columns)], row=cube_df.columns[0])
    v = cube.read_variables(t).localCheckpoint()
    assert cube.cube_table(t, v)._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
    assert "Join Inner, (obs" not in cube.cube_table(t, v)._jdf.queryExecution().optimizedPlan().toString()
