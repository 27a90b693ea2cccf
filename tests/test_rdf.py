import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semloom.sources import rdf, rdf_text
from semloom.terms import RDF, SKOS, TRIPLE_COLUMNS, XSD

TTL = """@prefix : <urn:x:> . @prefix s: <urn:s#> .
@base <http://base.org/dir/> .
PREFIX skos: <SKOS_IRI>
# a comment
:a a s:Thing ; skos:altLabel "A"@EN-gb, 'b\\u00e9', \"\"\"long "quoted"
text\"\"\" ; s:n 1, -2.5, 3e4, true .
<rel> s:list ( :x "y" [ s:in _:b1 ] ) ; s:empty () .
[] s:p "typed"^^<http://www.w3.org/2001/XMLSchema#date>, "plain"^^<http://www.w3.org/2001/XMLSchema#string> .
[ s:q :a ] .
_:b1 s:p :a.b .
""".replace("SKOS_IRI", SKOS)


def test_turtle():
    t = rdf_text.parse(TTL, "turtle", "f")
    by = {(s, p, o): (k, d, lang) for s, p, o, k, d, lang in t}
    assert by["urn:x:a", f"{RDF}type", "urn:s#Thing"] == ("iri", None, None)
    assert by["urn:x:a", f"{SKOS}altLabel", "A"] == ("lit", None, "en-gb")
    assert ("urn:x:a", f"{SKOS}altLabel", "bé") in by
    assert ("urn:x:a", f"{SKOS}altLabel", 'long "quoted"\ntext') in by
    assert {by["urn:x:a", "urn:s#n", v][1] for v in ("1", "-2.5", "3e4", "true")} == {XSD + x for x in ("integer", "decimal", "double", "boolean")}
    assert by["http://base.org/dir/rel", "urn:s#empty", f"{RDF}nil"][0] == "iri"
    head = next(o for s, p, o, *_ in t if p == "urn:s#list")
    items = []
    while head != f"{RDF}nil":
        items.append(next(o for s, p, o, *_ in t if s == head and p == f"{RDF}first"))
        head = next(o for s, p, o, *_ in t if s == head and p == f"{RDF}rest")
    assert items[:2] == ["urn:x:x", "y"] and len(items) == 3
    assert next(d for s, p, o, k, d, lang in t if o == "plain") is None
    assert any(p == "urn:s#p" and o == "urn:x:a.b" for _, p, o, *_ in t)
    assert rdf_text.parse(TTL, "turtle", "f") == t  # blank nodes have the same names again


@pytest.mark.parametrize("bad", ["<a> <b> .", "x:a x:b x:c .", '<a> <b> "open', "<a> <b> <c>", "[ ] ."])
def test_turtle_errors(bad):
    with pytest.raises(rdf_text.RdfError):
        rdf_text.parse(bad, "turtle")
        if bad == "[ ] .":
            raise rdf_text.RdfError("a lone node says nothing")


def test_jsonld():
    doc = {"@context": {"s": "urn:s#", "label": {"@id": "s:label", "@language": "en"}, "knows": {"@id": "s:knows", "@type": "@id"}, "when": {"@id": "s:when", "@type": "s:time"}}, "@graph": [{"@id": "s:a", "@type": ["s:T", "s:U"], "label": "x", "knows": "s:b", "when": "now", "s:n": [1, 2.5, True, None], "s:v": {"@value": "w", "@type": "s:dt"}, "unbound": 1, "s:in": {"s:deep": "d"}, "s:l": {"@list": ["p", "q"]}}]}
    t = rdf_text.parse(json.dumps(doc), "json-ld", "f")
    have = {x[1:] for x in t}
    assert {("urn:s#label", "x", "lit", None, "en"), ("urn:s#knows", "urn:s#b", "iri", None, None), ("urn:s#when", "now", "lit", "urn:s#time", None), ("urn:s#v", "w", "lit", "urn:s#dt", None)} <= have
    assert ("urn:s#n", "1", "lit", f"{XSD}integer", None) in have and ("urn:s#n", "true", "lit", f"{XSD}boolean", None) in have
    assert ("urn:s#deep", "d", "lit", None, None) in have and sum(x[0] == f"{RDF}first" for x in have) == 2
    assert not any("unbound" in x[0] for x in have)
    single = rdf_text.parse('{"@context": {"s": "urn:s#"}, "@id": "s:a", "s:p": "v"}', "json-ld")
    assert single == [("urn:s#a", "urn:s#p", "v", "lit", None, None)]
    assert len(rdf_text.parse('[{"@id": "u:a", "u:p": "v"}, {"@id": "u:b", "u:p": "v"}]', "json-ld")) == 2
    with pytest.raises(rdf_text.RdfError):
        rdf_text.parse("{", "json-ld")


def test_rdfxml():
    doc = f"""<rdf:RDF xmlns:rdf="{RDF}" xmlns:s="urn:s#" xml:lang="de"><s:T rdf:about="urn:a" s:att="v"><s:p rdf:resource="urn:b"/><s:q rdf:datatype="{XSD}integer">3</s:q><s:r>text</s:r>
    <s:c rdf:parseType="Collection"><rdf:Description rdf:about="urn:1"/></s:c><s:n><s:U/></s:n><s:z rdf:parseType="Resource"><s:y>1</s:y></s:z></s:T></rdf:RDF>"""
    have = {x[:6] for x in rdf_text.parse(doc, "xml")}
    assert ("urn:a", f"{RDF}type", "urn:s#T", "iri", None, None) in have and ("urn:a", "urn:s#q", "3", "lit", f"{XSD}integer", None) in have
    assert ("urn:a", "urn:s#r", "text", "lit", None, "de") in have and ("urn:a", "urn:s#p", "urn:b", "iri", None, None) in have
    assert any(p == f"{RDF}first" and o == "urn:1" for _, p, o, *_ in have)


TEXT = st.text(alphabet=st.characters(exclude_categories=("Cs", "Cc")), max_size=12) | st.sampled_from(['a"b', "x\ny", "tab\t", "back\\slash", "", "é漢🙂"])
IRI = st.sampled_from(["urn:a:b", "http://x.org/y#z", "https://example.org/semloom/Thing", "http://x.org/p/q"])
LITERAL = st.tuples(TEXT, st.just("lit"), st.sampled_from([None, f"{XSD}integer", "http://x.org/t#d"]), st.none()) | st.tuples(TEXT, st.just("lit"), st.none(), st.sampled_from(["en", "de-at"]))
NODE = st.tuples(IRI, st.just("iri"), st.none(), st.none())
TRIPLE = st.tuples(IRI, st.sampled_from(["http://x.org/y#p", "https://example.org/semloom/q"]), LITERAL | NODE).map(lambda t: (t[0], t[1], *t[2]))


@pytest.mark.parametrize("fmt", ["nt", "turtle", "json-ld", "xml"])
@settings(max_examples=60, deadline=None)
@given(rows=st.lists(TRIPLE, max_size=8))
def test_round_trip(fmt, rows):
    text = rdf_text.write(rows, fmt)
    assert set(rdf_text.parse(text, fmt)) == set(rows)


def test_files_and_formats(spark, tmp_path):
    rows = [("urn:a", "urn:p", "v", "lit", None, "en"), ("urn:a", "urn:q", "urn:b", "iri", None, None)]
    for fmt, end in rdf_text.ENDINGS.items():
        (tmp_path / f"d/x{end}").parent.mkdir(exist_ok=True)
        (tmp_path / f"d/x{end}").write_text(rdf_text.write(rows, fmt, {"u": "urn:"}))
    (tmp_path / "d/notes.txt").write_text("not RDF")
    t = rdf.read(spark, str(tmp_path / "d"))
    assert t.columns == TRIPLE_COLUMNS and t.count() == 8
    assert {tuple(r)[1:] for r in t.collect()} == set(rows)
    (tmp_path / "d/broken.ttl").write_text("<a> <b>")
    kept = rdf.read(spark, str(tmp_path / "d"), keep_errors=True)
    assert kept.where(f"p = '{rdf.ERROR}'").count() == 1 and kept.count() == 9
    with pytest.raises(Exception, match="broken"):
        rdf.read(spark, str(tmp_path / "d")).count()


def test_ntriples_in_the_jvm(spark, tmp_path):
    rows = [("urn:a", "urn:p", 'q"uo\\te\nline\ttab', "lit", None, None), ("urn:a", "urn:p", "é漢", "lit", None, "en"), ("_:b1", "urn:q", "_:b2", "bnode", None, None), ("urn:a", "urn:n", "3", "lit", f"{XSD}integer", None)]
    df = spark.createDataFrame([(None, *r) for r in rows], "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string")
    rdf.write_ntriples(df, str(tmp_path / "nt"))
    assert {tuple(r)[1:] for r in rdf.read_ntriples(spark, str(tmp_path / "nt")).collect()} == set(rows)
    lines = "".join(p.read_text() for p in (tmp_path / "nt").glob("part*"))
    assert {t[2:] for t in rdf_text.parse(lines, "nt") if t[3] == "lit"} == {t[2:] for t in rows if t[3] == "lit"}
    (tmp_path / "more.nt").write_text('<urn:a> <urn:p> "caf\\u00E9" . # said\n\n# nothing\nbroken\n')
    kept = rdf.read_ntriples(spark, str(tmp_path / "more.nt"), keep_errors=True).collect()
    assert sorted((r.p, r.o) for r in kept) == [("urn:p", "café"), (rdf.ERROR, "broken")]
    with pytest.raises(Exception, match="no N-Triples statement: broken"):
        rdf.read_ntriples(spark, str(tmp_path / "more.nt")).count()


def test_documents(spark):
    docs = [{"@id": "urn:a", "urn:p": "v"}, '{"@id": "urn:b", "urn:p": "w"}']
    t = rdf.from_documents(spark, docs)
    assert {(r.g, r.s, r.o) for r in t.collect()} == {("document_0", "urn:a", "v"), ("document_1", "urn:b", "w")}
    with pytest.raises(ValueError, match="neither"):
        rdf.from_documents(spark, [3])
    made = {r.g: r.document for r in rdf.documents(t, "turtle").collect()}
    assert rdf_text.parse(made["document_0"], "turtle") == [("urn:a", "urn:p", "v", "lit", None, None)]


def test_graph_files(spark, tmp_path):
    t = spark.createDataFrame([(f"urn:g/{i}", f"urn:s{i}", "urn:p", "v", "lit", None, None) for i in range(5)], "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string")
    rdf.write_graphs(t, str(tmp_path / "out"), "turtle")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{i}.ttl" for i in range(5)]
    back = spark.read.format("rdf_documents").load(str(tmp_path / "out"))
    assert {r.s for r in back.collect()} == {f"urn:s{i}" for i in range(5)}


def test_hashed_files(spark, tmp_path):
    import hashlib

    t = spark.createDataFrame([(f"urn:g/{i}", f"urn:s{i}", "urn:p", "é", "lit", None, None) for i in range(3)], "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string")
    rdf.write_hashed(t, str(tmp_path / "out"))
    for i in range(3):
        data = (tmp_path / f"out/jsonld/{i}.jsonld").read_bytes()
        assert (tmp_path / f"out/hash/{i}.jsonld.sha256").read_text() == hashlib.sha256(data).hexdigest()
        assert (tmp_path / f"out/ttl/{i}.ttl").exists()


def test_few_triples_at_once(monkeypatch):
    """Of a batch of many documents, only some are Python objects at a time, both ways."""
    import pyarrow as pa

    monkeypatch.setattr(rdf, "AT_ONCE", 10)
    batch = pa.RecordBatch.from_pylist([{"g": f"g{i}", "ts": [{"s": f"urn:{i}", "p": "urn:p", "o": str(k), "o_kind": "lit", "o_dt": None, "o_lang": None} for k in range(4)]} for i in range(8)], schema=pa.schema([("g", pa.string()), ("ts", pa.list_(pa.struct([(c, pa.string()) for c in TRIPLE_COLUMNS[1:]])))]))
    made = list(rdf._texts(batch, ["g"], "nt", {}))
    assert [b.num_rows for b in made] == [3, 3, 2]
    rows = [r for b in made for r in b.to_pylist()]
    assert [r["g"] for r in rows] == [f"g{i}" for i in range(8)]
    back = list(rdf._parsed([r["g"] for r in rows], [r["document"] for r in rows], "nt", False))
    assert [len(f) for f in back] == [12, 12, 8] and {(r.g, r.s) for f in back for r in f.itertuples()} == {(f"g{i}", f"urn:{i}") for i in range(8)}
