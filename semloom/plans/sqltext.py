"""Pieces of DuckDB SQL for the oracle: the engine's scalar functions and serialisation, said again in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from semloom.operators.serialize import Entry, expand_name, local_type
from semloom.terms import CURATORS_AT, DCT, HOME, LICENSES_AT, PREFIXES, PROV, QUDT, RDF, SKOS, STAGE_CODES, UNIT, XSD


def text(s: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if s is None else "'" + s.replace("'", "''") + "'"


def hash6(expr: str) -> str:
    acc = "CAST(0 AS HUGEINT)"
    for at in range(1, 65, 8):
        acc = f"(({acc} * 4294967296 + CAST('0x' || substr(sha256({expr}), {at}, 8) AS BIGINT)) % 900000)"
    return f"CAST({acc} + 100000 AS BIGINT)"


def row_key(template: Sequence[Entry]) -> str:
    stages: dict[str, list[str]] = {}
    for e in template:
        stages.setdefault(e.stage or "", []).append(f"coalesce(CAST({e.alt_label} AS VARCHAR), '')")
    return " || '-' || ".join(f"'{STAGE_CODES.get(s, 'UNK')}' || CAST({hash6(' || '.join(c))} AS VARCHAR)" for s, c in stages.items())


def triples(table: str, template: Sequence[Entry], orcid: str, at: str, key: str | None = None, types: Sequence[str] | None = None, base: str = HOME) -> str:
    """All triples that serialize.table_triples gives of a table."""
    digits = orcid.replace("-", "")
    parts = []
    for i, e in enumerate(template):
        s = f"'{base}{local_type(e.type)}.' || k"
        v = f"CASE WHEN trim(CAST({e.alt_label} AS VARCHAR)) <> '' THEN CAST({e.alt_label} AS VARCHAR) END"
        kind = types[i] if types else expand_name(e.type, PREFIXES)
        said = [
            (f"{RDF}type", text(kind), "iri", None, None), (f"{SKOS}altLabel", text(e.alt_label), "lit", None, None), (f"{SKOS}definition", text(e.definition), "lit", None, None),
            (f"{QUDT}hasUnit", text(UNIT + e.unit), "iri", None, None), (f"{PROV}generatedAtTime", text(at), "lit", f"{XSD}dateTime", None), (f"{SKOS}note", text(e.note), "lit", None, e.note_lang),
            (f"{base}hasStudyStage", text(e.stage), "lit", None, None), (f"{QUDT}value", v, "lit", None, None), (f"{base}row", "k", "lit", None, None),
            (f"{DCT}license", text(f"{LICENSES_AT}CC0-1.0.html"), "iri", None, None), (f"{DCT}creator", text(CURATORS_AT + orcid), "iri", None, None),
        ]
        parts += [f"SELECT g, {s} AS s, {text(p)} AS p, {o} AS o, '{kind_}' AS o_kind, {text(dt)} AS o_dt, {text(lang)} AS o_lang FROM src" for p, o, kind_, dt, lang in said]
    return f"WITH keyed AS (SELECT *, {key or row_key(template)} AS k FROM {table}), src AS (SELECT *, '{base}' || replace(k || '-or{digits}', ' ', '') AS g FROM keyed)\nSELECT * FROM (" + "\nUNION ALL ".join(parts) + ") t WHERE o IS NOT NULL"


def normalize(expr: str, extra: str = "") -> str:
    return f"regexp_replace(replace(lower({expr}), ' ', '_'), '[^a-zA-Z0-_.{extra}]', '', 'g')"


def sanitize_filename(expr: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({expr}, '[^\p{{L}}\p{{M}}\p{{N}}_]', '_', 'g'), '_+', '_', 'g'), '_')"


def near(label: str, keyword: str, d: int) -> str:
    """functions.near_match with a distance."""
    k = len(keyword)
    words = f"list_filter(regexp_split_to_array(translate(lower({label}), '-_', '  '), '\\s+'), lambda w: w <> '')"
    if d == 0:
        return f"len(list_filter({words}, lambda w: contains(w, '{keyword}'))) > 0"
    lengths = ", ".join(str(x) for x in range(k - d, k + d + 1))
    return f"len(list_filter({words}, lambda w: len(list_filter(range(1, greatest(length(w), 1) + 1), lambda i: len(list_filter([{lengths}], lambda n: levenshtein(substr(w, i, n), '{keyword}') <= {d})) > 0)) > 0)) > 0"
