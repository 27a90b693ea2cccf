"""RDF texts to triples and back, a document at a time: N-Triples, Turtle, JSON-LD and RDF/XML.

A triple is (s, p, o, kind, datatype, language). Blank nodes get names that depend on the document's name and their
place in it, so that reading twice gives equal triples.
"""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Mapping
from urllib.parse import urljoin
from xml.sax.saxutils import escape, quoteattr

from semloom.terms import PREFIXES, RDF, XSD

Triple = tuple[str, str, str, str, str | None, str | None]

FORMATS = {f".{end}": fmt for fmt, ends in {"xml": "rdf xml", "json-ld": "jsonld json-ld", "turtle": "ttl", "nt": "nt"}.items() for end in ends.split()}
ENDINGS = {"nt": ".nt", "turtle": ".ttl", "json-ld": ".jsonld", "xml": ".rdf"}


class RdfError(ValueError):
    """A text that isn't RDF of its format."""


def format_of(name: str) -> str | None:
    return next((f for end, f in FORMATS.items() if name.lower().endswith(end)), None)


def parse(text: str, fmt: str, name: str = "") -> list[Triple]:
    """The distinct triples of a document, in the order they come."""
    reader = {"nt": _turtle, "turtle": _turtle, "json-ld": _jsonld, "xml": _rdfxml}.get(fmt)
    if reader is None:
        raise RdfError(f"unknown format {fmt}")
    return list(dict.fromkeys(reader(text, hashlib.sha256(name.encode()).hexdigest()[:8])))


# --- Turtle and its subset N-Triples

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\s]*>)
    |(?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<dir>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=\s+[<\w:]))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<dt>\^\^)
    |(?P<bnode>_:[\w](?:[\w.\-]*[\w\-])?)
    |(?P<num>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))(?![\w:])
    |(?P<word>true|false|a)(?![\w:.\-]*[\w:\-])
    |(?P<name>(?:[A-Za-z\u00C0-\uFFFD][\w.\-]*)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:.\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
    |(?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _unescape(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), s) if "\\" in s else s


class _Turtle:
    def __init__(self, text: str, key: str):
        self.key, self.out, self.count = key, [], 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise RdfError(f"unexpected {text[at : at + 20]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.tokens[self.at]
        if value is not None and token[1] != value:
            raise RdfError(f"expected {value!r}, found {token[1]!r}")
        self.at += 1
        return token

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def fresh(self) -> str:
        self.count += 1
        return f"_:b{self.key}n{self.count}"

    def iri(self, kind: str, raw: str) -> str:
        if kind == "iri":
            found = _unescape(raw[1:-1])
            return urljoin(self.base, found) if self.base and "://" not in found else found
        prefix, _, rest = raw.partition(":")
        if prefix not in self.prefixes:
            raise RdfError(f"prefix {prefix!r} isn't bound")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", rest)

    def run(self) -> list[Triple]:
        while self.peek()[0] != "end":
            if self.peek()[0] == "dir":
                word = self.take()[1]
                if word.lstrip("@").lower() == "prefix":
                    name = self.take()[1]
                    self.prefixes[name[:-1]] = self.iri(*self.take())
                else:
                    self.base = self.iri(*self.take())
                if word.startswith("@"):
                    self.take(".")
                continue
            opened = self.peek()[1] == "["
            s = self.node()[0]
            if not (opened and self.peek()[1] == "."):
                self.predicates(s, ".")
            self.take(".")
        return self.out

    def predicates(self, s: str, end: str) -> None:
        while True:
            kind, raw = self.take()
            if kind == "word" and raw == "a":
                p = f"{RDF}type"
            elif kind in ("iri", "name"):
                p = self.iri(kind, raw)
            else:
                raise RdfError(f"{raw!r} is no predicate")
            while True:
                self.out.append((s, p, *self.node()))
                if self.peek()[1] != ",":
                    break
                self.take()
            if self.peek()[1] != ";":
                return
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] == end:
                return

    def node(self) -> tuple[str, str, str | None, str | None]:
        kind, raw = self.take()
        if kind in ("iri", "name"):
            return self.iri(kind, raw), "iri", None, None
        if kind == "bnode":
            return f"_:b{self.key}{raw[2:]}", "bnode", None, None
        if kind == "str":
            cut = 3 if raw[:3] in ('"""', "'''") else 1
            value, dt, lang = _unescape(raw[cut:-cut]), None, None
            if self.peek()[0] == "lang":
                lang = self.take()[1][1:].lower()
            elif self.peek()[0] == "dt":
                self.take()
                dt = self.iri(*self.take())
            return value, "lit", None if dt == f"{XSD}string" else dt, lang
        if kind == "num":
            dt = "double" if "e" in raw.lower() else "decimal" if "." in raw else "integer"
            return raw, "lit", XSD + dt, None
        if kind == "word" and raw != "a":
            return raw, "lit", f"{XSD}boolean", None
        if raw == "[":
            node = self.fresh()
            if self.peek()[1] != "]":
                self.predicates(node, "]")
            self.take("]")
            return node, "bnode", None, None
        if raw == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take(")")
            cells = [self.fresh() for _ in items]
            for i, item in enumerate(items):
                self.out.append((cells[i], f"{RDF}first", *item))
                after = (cells[i + 1], "bnode") if i + 1 < len(cells) else (f"{RDF}nil", "iri")
                self.out.append((cells[i], f"{RDF}rest", *after, None, None))
            return (cells[0], "bnode", None, None) if cells else (f"{RDF}nil", "iri", None, None)
        raise RdfError(f"unexpected {raw!r}")


def _turtle(text: str, key: str) -> list[Triple]:
    return _Turtle(text, key).run()


# --- JSON-LD


class _JsonLd:
    """Prefix and term contexts, @graph, @id, @type, @value, @language, @list, @reverse-free nesting."""

    def __init__(self, key: str):
        self.key, self.out, self.count = key, [], 0

    def fresh(self) -> str:
        self.count += 1
        return f"_:b{self.key}n{self.count}"

    def context(self, ctx, base: dict) -> dict:
        out = dict(base)
        for part in ctx if isinstance(ctx, list) else [ctx]:
            if isinstance(part, dict):
                for k, v in part.items():
                    if isinstance(v, str):
                        out[k] = v
                    elif isinstance(v, dict):
                        out[k] = v.get("@id", k)
                        if "@type" in v:
                            out[f"@type {k}"] = v["@type"]
                        if "@language" in v:
                            out[f"@language {k}"] = v["@language"]
        return out

    def expand(self, name: str, ctx: dict, term: bool) -> str | None:
        """IRI of a term, a prefix:rest or an absolute IRI; None of a bare word that isn't bound."""
        for _ in range(16):
            if term and name in ctx and ctx[name] != name:
                name = ctx[name]
                continue
            break
        if name.startswith(("_:", "@")):
            return f"_:b{self.key}{name[2:]}" if name.startswith("_:") else name
        prefix, colon, rest = name.partition(":")
        if colon:
            if not rest.startswith("//") and prefix in ctx:
                ns = self.expand(ctx[prefix], ctx, False) or ctx[prefix]
                return ns + rest
            return name
        if term:
            return ctx["@vocab"] + name if "@vocab" in ctx else None
        return urljoin(ctx["@base"], name) if "@base" in ctx else name

    def node(self, obj: dict, ctx: dict) -> str | None:
        if "@context" in obj:
            ctx = self.context(obj["@context"], ctx)
        raw = obj.get("@id")
        s = (self.expand(raw, ctx, False) or raw) if raw else self.fresh()
        for k, v in obj.items():
            if k in ("@context", "@id"):
                continue
            if k == "@graph":
                for x in v if isinstance(v, list) else [v]:
                    if isinstance(x, dict):
                        self.node(x, ctx)
                continue
            if k == "@type":
                for x in v if isinstance(v, list) else [v]:
                    if iri := self.expand(str(x), ctx, True):
                        self.out.append((s, f"{RDF}type", iri, "bnode" if iri.startswith("_:") else "iri", None, None))
                continue
            p = self.expand(k, ctx, True)
            if p is None or p.startswith("@") or ":" not in p:
                continue
            if p == f"{RDF}type" and isinstance(v, str):
                v = {"@id": v}
            for x in v if isinstance(v, list) else [v]:
                if (o := self.value(x, k, ctx)) is not None:
                    self.out.append((s, p, *o))
        return s

    def value(self, x, key: str, ctx: dict) -> tuple | None:
        if x is None:
            return None
        if isinstance(x, dict):
            if "@value" in x:
                lit = self.literal(x["@value"])
                if lit is None:
                    return None
                dt = self.expand(x["@type"], ctx, True) if x.get("@type") else lit[2]
                return lit[0], "lit", None if dt == f"{XSD}string" else dt, x["@language"].lower() if x.get("@language") else None
            if "@list" in x:
                items = [o for i in x["@list"] if (o := self.value(i, key, ctx)) is not None]
                cells = [self.fresh() for _ in items]
                for i, o in enumerate(items):
                    self.out.append((cells[i], f"{RDF}first", *o))
                    self.out.append((cells[i], f"{RDF}rest", *((cells[i + 1], "bnode") if i + 1 < len(cells) else (f"{RDF}nil", "iri")), None, None))
                return (cells[0], "bnode", None, None) if cells else (f"{RDF}nil", "iri", None, None)
            if not x.get("@id") and set(x) <= {"@id"}:
                return None
            s = self.node(x, ctx)
            return s, "bnode" if s.startswith("_:") else "iri", None, None
        as_type = ctx.get(f"@type {key}")
        if as_type in ("@id", "@vocab") and isinstance(x, str):
            iri = self.expand(x, ctx, as_type == "@vocab") or x
            return iri, "bnode" if iri.startswith("_:") else "iri", None, None
        lit = self.literal(x)
        if lit is None:
            return None
        lang = ctx.get(f"@language {key}", ctx.get("@language")) if isinstance(x, str) and not as_type else None
        dt = self.expand(as_type, ctx, True) if as_type else lit[2]
        return lit[0], "lit", None if dt == f"{XSD}string" else dt, lang.lower() if lang else None

    @staticmethod
    def literal(x) -> tuple[str, str, str | None] | None:
        if isinstance(x, bool):
            return str(x).lower(), "lit", f"{XSD}boolean"
        if isinstance(x, int):
            return str(x), "lit", f"{XSD}integer"
        if isinstance(x, float):
            return repr(x), "lit", f"{XSD}double"
        return (x, "lit", None) if isinstance(x, str) else None


def _jsonld(text: str, key: str) -> list[Triple]:
    try:
        doc = json.loads(text)
    except json.JSONDecodeError as e:
        raise RdfError(str(e)) from e
    reader = _JsonLd(key)
    for x in doc if isinstance(doc, list) else [doc]:
        if not isinstance(x, dict):
            raise RdfError("a JSON-LD document is an object or an array of objects")
        if "@graph" in x and not x.get("@id"):
            ctx = reader.context(x.get("@context", {}), {})
            for n in x["@graph"] if isinstance(x["@graph"], list) else [x["@graph"]]:
                reader.node(n, ctx)
        elif set(x) - {"@context"}:
            reader.node(x, {})
    return reader.out


# --- RDF/XML

_XML = "{http://www.w3.org/XML/1998/namespace}"


def _rdfxml(text: str, key: str) -> list[Triple]:
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise RdfError(str(e)) from e
    out: list[Triple] = []
    count = 0
    r = f"{{{RDF}}}"
    base = root.get(f"{_XML}base", "")

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:b{key}n{count}"

    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def node(e: ET.Element, lang: str | None) -> str:
        lang = e.get(f"{_XML}lang", lang)
        if (about := e.get(f"{r}about")) is not None:
            s = urljoin(base, about) if base else about
        elif (ident := e.get(f"{r}ID")) is not None:
            s = f"{base}#{ident}"
        elif (label := e.get(f"{r}nodeID")) is not None:
            s = f"_:b{key}{label}"
        else:
            s = fresh()
        if name(e.tag) != f"{RDF}Description":
            out.append((s, f"{RDF}type", name(e.tag), "iri", None, None))
        for k, v in e.attrib.items():
            if not k.startswith((r, _XML)) and k.startswith("{"):
                out.append((s, name(k), v, "lit", None, lang))
            elif k == f"{r}type":
                out.append((s, f"{RDF}type", v, "iri", None, None))
        for n, c in enumerate(e, 1):
            prop(s, c, lang, n)
        return s

    def prop(s: str, e: ET.Element, lang: str | None, n: int) -> None:
        lang = e.get(f"{_XML}lang", lang)
        p = name(e.tag)
        if p == f"{RDF}li":
            p = f"{RDF}_{n}"
        kind = e.get(f"{r}parseType")
        if (res := e.get(f"{r}resource")) is not None:
            out.append((s, p, urljoin(base, res) if base else res, "iri", None, None))
        elif (label := e.get(f"{r}nodeID")) is not None:
            out.append((s, p, f"_:b{key}{label}", "bnode", None, None))
        elif kind == "Resource":
            b = fresh()
            out.append((s, p, b, "bnode", None, None))
            for m, c in enumerate(e, 1):
                prop(b, c, lang, m)
        elif kind == "Collection":
            items = [node(c, lang) for c in e]
            cells = [fresh() for _ in items]
            out.append((s, p, *((cells[0], "bnode") if cells else (f"{RDF}nil", "iri")), None, None))
            for i, o in enumerate(items):
                out.append((cells[i], f"{RDF}first", o, "bnode" if o.startswith("_:") else "iri", None, None))
                out.append((cells[i], f"{RDF}rest", *((cells[i + 1], "bnode") if i + 1 < len(cells) else (f"{RDF}nil", "iri")), None, None))
        elif len(e):
            for c in e:
                o = node(c, lang)
                out.append((s, p, o, "bnode" if o.startswith("_:") else "iri", None, None))
        else:
            dt = e.get(f"{r}datatype")
            out.append((s, p, e.text or "", "lit", None if dt == f"{XSD}string" else dt, None if dt else lang and lang.lower()))

    if name(root.tag) == f"{RDF}RDF":
        for c in root:
            node(c, root.get(f"{_XML}lang"))
    else:
        node(root, None)
    return out


# --- writers

_QUOTE = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _quoted(s: str) -> str:
    return '"' + "".join(_QUOTE.get(c, c) if c >= " " or c in _QUOTE else f"\\u{ord(c):04X}" for c in s) + '"'


_LOCAL = re.compile(r"[A-Za-z0-9_](?:[\w\-.]*[\w\-])?")


def _short(iri: str, prefixes: Mapping[str, str]) -> str | None:
    best = max(((ns, p) for p, ns in prefixes.items() if iri.startswith(ns)), key=lambda x: len(x[0]), default=None)
    if best and _LOCAL.fullmatch(iri[len(best[0]) :]):
        return f"{best[1]}:{iri[len(best[0]) :]}"
    return None


def _term(o: str, kind: str, dt: str | None, lang: str | None, name) -> str:
    if kind == "lit":
        return _quoted(o) + (f"@{lang}" if lang else f"^^{name(dt)}" if dt else "")
    return o if kind == "bnode" or o.startswith("_:") else name(o)


def write(triples: Iterable[Triple], fmt: str, prefixes: Mapping[str, str] = PREFIXES) -> str:
    """A document of the triples, sorted, so that equal sets give equal texts."""
    rows = sorted(set(triples), key=lambda t: tuple(x or "" for x in t))
    if fmt == "nt":
        full = lambda i: f"<{i}>"
        return "".join(f"{_term(t[0], 'iri', None, None, full)} <{t[1]}> {_term(*t[2:], full)} .\n" for t in rows)
    by: dict[str, list[Triple]] = {}
    for t in rows:
        by.setdefault(t[0], []).append(t)
    if fmt == "turtle":
        name = lambda i: _short(i, prefixes) or f"<{i}>"
        used = {p for t in rows for x in (t[0], t[1], t[2] if t[3] == "iri" else t[4] or "") if (q := _short(x, prefixes)) and (p := q.split(":")[0])}
        head = "".join(f"@prefix {p}: <{prefixes[p]}> .\n" for p in sorted(used))
        body = []
        for s, own in by.items():
            lines = [f"    {'a' if t[1] == f'{RDF}type' else name(t[1])} {_term(*t[2:], name)}" for t in own]
            body.append(f"{_term(s, 'iri', None, None, name)}\n" + " ;\n".join(lines) + " .\n")
        return head + "\n" + "\n".join(body)
    if fmt == "json-ld":
        short = lambda i: _short(i, prefixes) or i
        graph = []
        for s, own in by.items():
            entry: dict = {"@id": s if s.startswith("_:") else short(s)}
            for _, p, o, kind, dt, lang in own:
                if p == f"{RDF}type" and kind == "iri":
                    k, v = "@type", short(o)
                else:
                    k = short(p)
                    v = {"@id": o if kind == "bnode" else short(o)} if kind != "lit" else o if not dt and not lang else {"@value": o, **({"@language": lang} if lang else {"@type": short(dt)})}
                entry.setdefault(k, []).append(v)
            graph.append({k: v if k == "@id" or len(v) > 1 else v[0] for k, v in entry.items()})
        return json.dumps({"@context": dict(sorted(prefixes.items())), "@graph": graph}, indent=2, ensure_ascii=False)
    if fmt == "xml":
        spaces: dict[str, str] = {RDF: "rdf"}
        out = []
        for s, own in by.items():
            ident = f"rdf:nodeID={quoteattr(s[2:])}" if s.startswith("_:") else f"rdf:about={quoteattr(s)}"
            out.append(f"  <rdf:Description {ident}>")
            for _, p, o, kind, dt, lang in own:
                m = re.search(r"[A-Za-z_][\w.\-]*$", p)
                if not m or not m.start():
                    raise RdfError(f"{p} has no XML name")
                tag = f"{spaces.setdefault(p[: m.start()], f'n{len(spaces)}')}:{m[0]}"
                if kind == "lit":
                    extra = f" xml:lang={quoteattr(lang)}" if lang else f" rdf:datatype={quoteattr(dt)}" if dt else ""
                    out.append(f"    <{tag}{extra}>{escape(o)}</{tag}>")
                else:
                    out.append(f"    <{tag} rdf:{'nodeID' if kind == 'bnode' else 'resource'}={quoteattr(o[2:] if kind == 'bnode' else o)}/>")
            out.append("  </rdf:Description>")
        names = "".join(f" xmlns:{p}={quoteattr(ns)}" for ns, p in spaces.items())
        return '<?xml version="1.0" encoding="UTF-8"?>\n' + f"<rdf:RDF{names}>\n" + "\n".join(out) + "\n</rdf:RDF>\n"
    raise RdfError(f"unknown format {fmt}")
