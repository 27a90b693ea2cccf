"""Scalar functions: Column in, Column out, all of built-in expressions so that they stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from semloom.terms import ENTITY, LICENSES_AT, PREFIXES, STAGE_CODES

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- keys


def hash6(text: C) -> Column:
    """A number of six digits from SHA-256: its 256 bits modulo 900000, plus 100000. The hex digest is folded by words
    of 32 bits, so no intermediate value leaves a bigint. Null for null."""
    digest = F.sha2(_c(text).cast("string"), 256)
    acc = F.lit(0).cast("bigint")
    for at in range(1, 65, 8):
        word = F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
        acc = (acc * 4294967296 + word) % 900000
    return acc + 100000


def stage_code(stage: C) -> Column:
    """Short code of a study stage; UNK for one that isn't known, empty or null."""
    out = F.lit("UNK")
    for name, code in STAGE_CODES.items():
        out = F.when(_c(stage) == name, F.lit(code)).otherwise(out)
    return out


def row_key(columns_by_stage: Mapping[str, Sequence[C]]) -> Column:
    """Code and hash6 of the joined texts of each stage's columns, stages in the given order and joined by "-". Null
    texts count as nothing. A projection: no row needs another one."""
    parts = [F.concat(stage_code(F.lit(stage)), hash6(F.concat_ws("", *[_c(c).cast("string") for c in columns])).cast("string")) for stage, columns in columns_by_stage.items()]
    return F.concat_ws("-", *parts)


def key_from_columns(columns: Sequence[C]) -> Column:
    """Trimmed texts joined by "-", in the given order; null texts are empty."""
    return F.concat_ws("-", *[F.coalesce(F.trim(_c(c).cast("string")), F.lit("")) for c in columns])


def full_row_key(key: C, orcid: C) -> Column:
    """The key with the curator's digits, without spaces: the name of a row's graph."""
    return F.replace(F.concat(_c(key), F.lit("-or"), F.replace(_c(orcid), F.lit("-"), F.lit(""))), F.lit(" "), F.lit(""))


def salt_letter(key: C) -> Column:
    """A letter a-z that depends on the key alone, to spread file names over a store's key range."""
    word = F.conv(F.substring(F.sha2(_c(key).cast("string"), 256), 1, 8), 16, 10).cast("bigint")
    return F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (word % 26 + 1).cast("int"), F.lit(1))


def content_sha256(content: C) -> Column:
    return F.sha2(_c(content), 256)


def id_string(*parts: C) -> Column:
    return F.concat_ws("_", *[_c(p).cast("string") for p in parts])


# --- labels and names


def normalize(text: C) -> Column:
    """Lower case, spaces as "_", then only letters, dots and the characters from "0" to "_" of ASCII stay."""
    return F.regexp_replace(F.replace(F.lower(_c(text)), F.lit(" "), F.lit("_")), "[^a-zA-Z0-_.]", "")


def normalize_iri(text: C) -> Column:
    """normalize() that keeps slashes."""
    return F.regexp_replace(F.replace(F.lower(_c(text)), F.lit(" "), F.lit("_")), "[^a-zA-Z0-_./]", "")


def normalize_strict(text: C) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]", "")


def sanitize_filename(text: C) -> Column:
    """Runs of other than word characters as one "_", none at either end."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text).cast("string"), r"(?U)\W", "_"), "_+", "_"), F.lit("_"))


def sanitize_iri(text: C) -> Column:
    """sanitize_filename(): a leading digit gets a "_" first, which the trimming of both ends takes away again."""
    worded = F.regexp_replace(_c(text).cast("string"), r"(?U)\W", "_")
    worded = F.regexp_replace(worded, r"^([0-9])", "_$1")
    return F.trim(F.regexp_replace(worded, "_+", "_"), F.lit("_"))


def dataset_name(text: C) -> Column:
    """Each character that isn't a word's as "_", and one before a leading digit."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"(?U)\W", "_"), r"^(?=\d)", "_")


def entity_id(value: C) -> Column:
    """The part of an IRI that names an entity after a cell's value."""
    return normalize(F.regexp_replace(_c(value).cast("string"), r"[^a-zA-Z0-9_.\-]", ""))


def percent_encode(text: C) -> Column:
    """All but unreserved characters as %XX of their UTF-8 bytes."""
    out = F.url_encode(_c(text))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


# --- IRIs


def local_name(iri: C) -> Column:
    """What follows the last "/", or else the last "#"."""
    iri = _c(iri)
    return F.when(iri.contains("/"), F.substring_index(iri, "/", -1)).otherwise(F.substring_index(iri, "#", -1))


def fragment(iri: C) -> Column:
    """What follows the last "/" or "#", whichever is later."""
    return F.regexp_extract(_c(iri), r"([^/#]*)$", 1)


def base_iri(iri: C) -> Column:
    """All up to the last "/" or "#" and with it; the whole IRI where there is neither."""
    iri = _c(iri)
    return F.when(iri.rlike("[/#]"), F.regexp_extract(iri, r"^(.*[/#])", 1)).otherwise(iri)


def curie(iri: C, bindings: Mapping[str, str] = PREFIXES, fallback: str = ENTITY) -> Column:
    """prefix:rest under the longest namespace that begins the IRI; the fallback where none does."""
    iri, out = _c(iri), F.lit(fallback)
    for prefix, ns in sorted(bindings.items(), key=lambda kv: (len(kv[1]), kv[0])):
        if not prefix.startswith("@"):
            rest = F.regexp_replace(F.substr(iri, F.lit(len(ns) + 1)), "^[#/]+", "")
            out = F.when(iri.startswith(ns), F.concat(F.lit(f"{prefix}:"), rest)).otherwise(out)
    return out


def prefixed_name(iri: C, bindings: Mapping[str, str] = PREFIXES) -> Column:
    """prefix:rest under the first namespace, in the map's order, that begins the IRI; else the IRI as it is."""
    iri = _c(iri)
    out = iri
    for prefix, ns in reversed(list(bindings.items())):
        out = F.when(iri.startswith(ns), F.concat(F.lit(f"{prefix}:"), F.substr(iri, F.lit(len(ns) + 1)))).otherwise(out)
    return out


def is_absolute(iri: C) -> Column:
    return _c(iri).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]")


def expand(name: C, bindings: Mapping[str, str] = PREFIXES) -> Column:
    """IRI of an absolute IRI or a prefix:rest whose prefix is bound; null of anything else."""
    name = _c(name)
    table = F.create_map(*[F.lit(x) for kv in bindings.items() for x in kv]) if bindings else None
    prefix = F.substring_index(name, ":", 1)
    known = F.concat(F.try_element_at(table, prefix), F.substr(name, F.length(prefix) + 2)) if table is not None else F.lit(None).cast("string")
    return F.when(is_absolute(name), name).when(name.contains(":"), known)


def type_local_name(type_: C) -> Column:
    """Local name of a type given as IRI, prefix:rest or bare name."""
    t = F.trim(_c(type_))
    return F.when(t.contains("://"), fragment(t)).when(t.contains(":"), F.substr(t, F.locate(":", t) + 1)).otherwise(t)


def property_iri(name: C, existing: C, namespace: str, bindings: Mapping[str, str] = PREFIXES) -> Column:
    """A variable's property: its existing IRI (absolute or prefix:rest), else its name in the namespace. A prefix that
    isn't bound is an error."""
    existing = _c(existing)
    unknown = F.raise_error(F.concat(F.lit("unknown prefix in "), existing)).cast("string")
    own = F.concat(F.lit(namespace), F.replace(_c(name), F.lit(" "), F.lit("_")))
    return F.when(F.coalesce(F.trim(existing), F.lit("")) == "", own).otherwise(F.coalesce(expand(F.trim(existing), bindings), unknown))


def unit_iri(unit: C, namespace: str, bindings: Mapping[str, str] = PREFIXES) -> Column:
    """A unit's IRI: prefix:rest expanded (null if the prefix is unknown), else its name in the namespace; null of an
    empty one."""
    u = F.replace(F.trim(_c(unit)), F.lit(" "), F.lit("_"))
    return F.when(u == "", F.lit(None).cast("string")).when(u.contains(":"), expand(u, bindings)).otherwise(F.concat(F.lit(namespace), u))


def license_iri(license_: C, known: Sequence[str] | None = None) -> Column:
    """An http IRI as it is, a known SPDX id as its page, CC0-1.0 where there is none; another id is an error."""
    lic = _c(license_)
    page = F.concat(F.lit(LICENSES_AT), F.coalesce(lic, F.lit("CC0-1.0")), F.lit(".html"))
    out = F.when(F.coalesce(lic, F.lit("")) == "", F.lit(f"{LICENSES_AT}CC0-1.0.html")).when(lic.startswith("http"), lic)
    if known is None:
        return out.otherwise(page)
    return out.when(lic.isin(*known), page).otherwise(F.raise_error(F.concat(F.lit("unknown licence "), lic)).cast("string"))


# --- checks


def orcid_valid(orcid: C) -> Column:
    """Four groups of four digits; the check letter X isn't taken."""
    return _c(orcid).rlike(r"^\d{4}(-\d{4}){3}$")


def digits(text: C) -> Column:
    return F.regexp_replace(_c(text), r"[^0-9]", "")


def alnum_id(text: C) -> Column:
    return _c(text).rlike(r"^[A-Za-z0-9]+$")


def is_blank(value: C) -> Column:
    """Null, NaN or nothing but white space."""
    text = _c(value).cast("string")
    return text.isNull() | (F.trim(text) == "") | (text == "NaN")


# --- search


def adaptive_distance(keyword: C) -> Column:
    """Edits that a keyword of this length may differ by."""
    n = F.length(_c(keyword))
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def near_match(label: C, keyword: str, distance: int | None = None) -> Column:
    """Whether some word of the label holds a piece within `distance` edits of the keyword; "-" and "_" part words. A
    keyword no longer than the distance matches every word."""
    key = keyword.strip().lower()
    k = len(key)
    d = (0 if k <= 2 else 1 if k <= 5 else 2) if distance is None else distance
    words = F.filter(F.split(F.translate(F.lower(_c(label)), "-_", "  "), r"\s+"), lambda w: w != "")
    if d == 0:
        return F.exists(words, lambda w: w.contains(key))

    def near(w: Column) -> Column:
        if k <= d:
            return F.length(w) > 0
        starts = F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1)))
        lengths = F.array(*[F.lit(x) for x in range(k - d, k + d + 1)])
        return F.exists(starts, lambda i: F.exists(lengths, lambda n: F.levenshtein(F.substr(w, i, n), F.lit(key)) <= d))

    return F.exists(words, near)


# --- shapes and times


def shape_string(array: C, depth: int = 1) -> Column:
    """Sizes of an array and, by first elements, of what is nested in it: "3x4"."""
    a, sizes = _c(array), []
    for _ in range(depth):
        sizes.append(F.size(a).cast("string"))
        a = F.get(a, F.lit(0))
    return F.concat_ws("x", *sizes)


def iso_instant(ts: C) -> Column:
    """UTC instant of xsd:dateTime with one zone mark; the session's time zone is to be UTC."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def compact_instant(ts: C) -> Column:
    return F.date_format(_c(ts), "yyyyMMddHHmmss")


def shorten(text: C, length: int) -> Column:
    """The first `length` characters and "..." of a longer text."""
    return F.when(F.length(_c(text)) > length, F.concat(F.substring(_c(text), 1, length), F.lit("..."))).otherwise(_c(text))
