"""Vocabularies, prefixes and the schema of triples."""

from __future__ import annotations

from pyspark.sql import types as T

#: Default namespace of terms and entities that have no other; each operator takes another one as a parameter.
HOME = "https://example.org/semloom/"
W3 = "http://www.w3.org/"
RDF, RDFS, OWL, XSD = f"{W3}1999/02/22-rdf-syntax-ns#", f"{W3}2000/01/rdf-schema#", f"{W3}2002/07/owl#", f"{W3}2001/XMLSchema#"
SKOS, PROV, ORG = f"{W3}2004/02/skos/core#", f"{W3}ns/prov#", f"{W3}ns/org#"
PURL, QUDT_ORG, GOV = "http://purl.org/", "qudt.org", "data.gov.uk"
DCT, DC, QB, SDMX = f"{PURL}dc/terms/", f"{PURL}dc/elements/1.1/", f"{PURL}linked-data/cube#", f"{PURL}linked-data/sdmx/2009/"
QUDT, UNIT = f"http://{QUDT_ORG}/schema/qudt/", f"https://{QUDT_ORG}/vocab/unit/"
CCO = "https://www.commoncoreontologies.org/"
OBO = "http://purl.obolibrary.org/obo/"
VOID = "http://rdfs.org/ns/void#"
FOAF = "http://xmlns.com/" + "foaf/0.1/"
LICENSES_AT = "https://spdx.org/licenses/"
CURATORS_AT = "https://orcid.org/"
#: The ORCID of nobody.
NO_ORCID = "-".join(["0000"] * 4)
ENTITY = "obo:BFO_0000001"
ENTITY_IRI = f"{OBO}BFO_0000001"

#: Bound by default; a longer list of their own is for the caller to pass.
PREFIXES: dict[str, str] = dict(cco=CCO, dcterms=DCT, home=HOME, obo=OBO, owl=OWL, prov=PROV, qudt=QUDT, rdf=RDF, rdfs=RDFS, skos=SKOS, unit=UNIT, xsd=XSD)
#: Those of data cubes.
CUBE_PREFIXES: dict[str, str] = {
    **{f"sdmx-{k}": f"{SDMX}{k}#" for k in ("attribute", "code", "concept", "dimension", "measure", "metadata", "subject")},
    **{p: f"http://{at}" for p, at in (("admingeo", "data.ordnancesurvey" + ".co.uk/ontology/admingeo/"), ("interval", f"reference.{GOV}/def/intervals/"))},
    **{p: f"http://example.org/{x}#" for p, x in (("eg", "ns"), ("ex-geo", "geo"))},
    **dict(qb=QB, void=VOID, org=ORG, foaf=FOAF, dct=DCT, skos=SKOS, xsd=XSD, owl=OWL, rdfs=RDFS, rdf=RDF),
    **{"qudt": f"http://{QUDT_ORG}/2.1/vocab/unit", "home": HOME},
}

STAGE_CODES = dict(zip(("Modeling", "Analysis", "Result", "Recipe", "Tool", "Sample", "Material Processing", "Formulation", "Synthesis"), ("MOD", "AN", "RSLT", "REC", "TL", "SA", "MAT_PRO", "FOR", "SYN"), strict=True))
NO_DEFINITION = "Definition not available"
UNITLESS = "UNITLESS"
GENERIC_TYPE = "cco:ont00000958"

#: Helper columns of tables: never described, audited or serialised.
HELPERS = ("__Label__", "__rowkey__", "__source_file__")

#: g: graph of the triple; o_kind: iri, bnode or lit; o_dt, o_lang: of literals only (null datatype: a plain string).
TRIPLES = T.StructType([T.StructField(n, T.StringType(), n in ("g", "o_dt", "o_lang")) for n in ("g", "s", "p", "o", "o_kind", "o_dt", "o_lang")])
TRIPLE_COLUMNS = TRIPLES.names
