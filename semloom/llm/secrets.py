"""Secret scan over a recursive decoding worklist.

Every text is a layer. A layer is scanned by the rules; then each way to unwrap it (percent escapes, Unicode escapes,
base64, and gzip, zlib or bzip2 inside base64) adds the layers it yields to the worklist, until nothing new comes.
A layer that was seen before in the same text, by content and place, isn't taken again, so cycles end. An escape that is
escaped many times over ("%252525...") is taken down to its last level at once, so that depth costs no layers. Each layer
keeps a map of its characters to spans of the original text, and findings are reported there.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semloom.llm.common import pick, positional, text_slices

#: rule -> (literals of which the text must hold one, pattern; group "s" is the secret).
RULES: dict[str, tuple[tuple[str, ...], re.Pattern[str]]] = {
    "aws_access_key": (("AKIA", "ASIA"), re.compile(r"\b(?P<s>A(?:KIA|SIA)[A-Z2-7]{16})\b")),
    "github_token": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), re.compile(r"\b(?P<s>(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}))")),
    "slack_token": (("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), re.compile(r"\b(?P<s>xox[abprs]-[A-Za-z0-9-]{10,})")),
    "google_api_key": (("AIza",), re.compile(r"\b(?P<s>AIza[A-Za-z0-9_-]{35})")),
    "stripe_key": (("sk_live_", "rk_live_"), re.compile(r"\b(?P<s>[sr]k_live_[A-Za-z0-9]{16,})")),
    "jwt": (("eyJ",), re.compile(r"\b(?P<s>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")),
    "private_key": (("PRIVATE KEY-----",), re.compile(r"(?P<s>-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?-----END (?:[A-Z]+ )*PRIVATE KEY-----)")),
    "url_password": (("://",), re.compile(r"://[^\s/:@]+:(?P<s>[^\s/:@]{4,})@")),
}
_NAMES = ("token", "secret", "passwd", "password", "api_key", "apikey", "api-key", "access_key", "access-key", "accesskey", "auth_key", "client_key")
_NAME = re.compile(r"(?i)token|secret|passwo?r?d|api[_-]?key|access[_-]?key|auth_key|client_key")
_ASSIGNED = re.compile(r"(?:=>|:=|=|:)[ \t]*[\"']?(?=[A-Za-z0-9_\-./+=]{16})")
_VALUE = re.compile(r"[A-Za-z0-9_\-./+=]+")
_PERCENT = re.compile(r"(?:%25(?:25)+|%[0-9A-Fa-f]{2})+")
_PERCENT_UNIT = re.compile(r"%25(?:25)+|%..")
_UNICODE = re.compile(r"\\u005[cC](?:u005[cC])+|\\x5[cC](?:x5[cC])+|&#38;(?:#38;)+|(?:\\u(?!005[cC]u005[cC])[0-9A-Fa-f]{4})+|\\u\{0*[0-9A-Fa-f]{1,6}\}|(?:\\x(?!5[cC]x5[cC])[0-9A-Fa-f]{2})+|&#x0*[0-9A-Fa-f]{1,6};|&#0*[0-9]{1,7};")
#: A backslash or an ampersand that is escaped twice or more.
_NESTED = re.compile(r"\\(?:u005[cC]){2,}|\\(?:x5[cC]){2,}|&#38;(?:#38;)+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
#: A compressed layer that unpacks to more characters than this is reported as rule "oversize_layer", not unpacked.
MAX_UNPACKED = 1 << 26


class Finding(NamedTuple):
    rule: str
    path: str  # how the layer was unwrapped, as in "url>base64>gzip"; empty in the text itself
    start: int  # characters of the original text
    end: int
    secret: str


class Layer(NamedTuple):
    text: str
    path: tuple[str, ...]
    #: Pieces as (start in this layer, start and end in the original, whether a character there is one here).
    at: list[int]
    spans: list[tuple[int, int, bool]]

    def place(self, start: int, end: int) -> tuple[int, int]:
        """The span of the original text that text[start:end] comes from."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, max(start, end - 1)) - 1
        (a, b, one), (c, d, last) = self.spans[i], self.spans[j]
        return (a + start - self.at[i] if one else a), (c + end - self.at[j] if last else d)


def _entropic(s: str) -> bool:
    """Whether an assigned value looks random: a digit and a letter, and no character for more than a third."""
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and max(map(s.count, set(s))) * 3 <= len(s)


def scan_layer(text: str) -> Iterator[tuple[str, int, int]]:
    for rule, (literals, pattern) in RULES.items():
        if any(x in text for x in literals):
            for m in pattern.finditer(text):
                yield rule, *m.span("s")
    low = text.lower()
    if any(x in low for x in _NAMES):
        pos = 0
        while m := _ASSIGNED.search(text, pos):
            pos = m.end()
            if _NAME.search(_word_before(text, m.start())):
                v = _VALUE.match(text, pos)
                pos = v.end()
                if _entropic(v[0]):
                    yield "assigned_secret", *v.span()


def _word_before(text: str, end: int) -> str:
    """The word that ends there, or before spaces and a quote there."""
    while end and text[end - 1] in " \t":
        end -= 1
    end -= bool(end) and text[end - 1] in "\"'"
    start = end
    while start and (text[start - 1].isalnum() or text[start - 1] in "_-"):
        start -= 1
    return text[start:end]


def _replaced(layer: Layer, pattern: re.Pattern[str], how: str, decode) -> Layer | None:
    """The layer with each match decoded; the rest of its text stays, one to one."""
    out, at, spans, pos, size = [], [], [], 0, 0

    def add(piece: str, a: int, b: int, plain: bool) -> None:
        nonlocal size
        if not piece:
            return
        if plain:  # keep the pieces of the layer below
            k = bisect_right(layer.at, a) - 1
            while a < b:
                stop = min(b, layer.at[k + 1] if k + 1 < len(layer.at) else b)
                at.append(size)
                s, e, one = layer.spans[k]
                spans.append((s + a - layer.at[k], s + stop - layer.at[k], True) if one else (s, e, False))
                size += stop - a
                a, k = stop, k + 1
        else:
            at.append(size)
            spans.append((*layer.place(a, b), False))
            size += len(piece)
        out.append(piece)

    for m in pattern.finditer(layer.text):
        try:
            new = decode(m[0])
        except (ValueError, OverflowError):
            continue
        add(layer.text[pos : m.start()], pos, m.start(), True)
        for piece, a, b in new:
            add(piece, m.start() + a, m.start() + b, False)
        pos = m.end()
    if not pos:
        return None
    add(layer.text[pos:], pos, len(layer.text), True)
    return Layer("".join(out), (*layer.path, how), at or [0], spans or [(*layer.place(0, len(layer.text)), False)])


def _percent(s: str) -> list[tuple[str, int, int]]:
    """UTF-8 characters; a byte that belongs to none is U+FFFD."""
    units = list(_PERCENT_UNIT.finditer(s))
    data, ends = bytes(int(m[0][1:3], 16) for m in units), [0, *(m.end() for m in units)]
    out, at = [], 0
    while at < len(data):
        n = 1 if data[at] < 0xC0 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        try:
            c = data[at : at + n].decode()
        except UnicodeDecodeError:
            c, n = "\ufffd", 1
        out.append((c, ends[at], ends[at + n]))
        at += n
    return out


def _unicode(s: str) -> list[tuple[str, int, int]]:
    if _NESTED.fullmatch(s):
        return [(s[0], 0, len(s))]
    if s.startswith("&#x"):
        return [(chr(int(s[3:-1], 16)), 0, len(s))]
    if s.startswith("&#"):
        return [(chr(int(s[2:-1])), 0, len(s))]
    if s.startswith("\\u{"):
        return [(chr(int(s[3:-1], 16)), 0, len(s))]
    step = 6 if s[1] == "u" else 4
    units = [int(s[i + 2 : i + step], 16) for i in range(0, len(s), step)]
    out, i = [], 0
    while i < len(units):
        u, n = units[i], 1
        if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
            u, n = 0x10000 + ((u - 0xD800) << 10) + units[i + 1] - 0xDC00, 2
        if 0xD800 <= u < 0xE000:
            raise ValueError("lone surrogate")
        out.append((chr(u), i * step, (i + n) * step))
        i += n
    return out


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(1 for c in text if not (c.isprintable() or c in "\r\n\t"))
    return text if text and odd * 20 <= len(text) else None


#: Stretches of UTF-8 without control characters that may hold a secret or a layer (the shortest secret, of url_password, takes 10).
_STRETCH = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){10,}")
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\x78[\x01\x5e\x9c\xda]")
_SEPARATOR = re.compile(r"[/_-]")
#: What the secrets begin with that must begin a word, and bytes that are read for one from a separator on.
_BOUNDED = (b"AKIA", b"ASIA", b"AIza", b"gh", b"xox", b"sk_", b"rk_", b"eyJ")
PART_BYTES = 1 << 14


def _stream(data: memoryview, kind: str) -> tuple[bytes, int, bool]:
    """(content, bytes taken, whether it ended) of the stream, and of those of its kind that follow at once."""
    out, at, ended = b"", 0, False
    while at < len(data) and (not at or (m := _PACKED.match(data, at)) and _kind(m[0]) == kind):
        stream = bz2.BZ2Decompressor() if kind == "bzip2" else zlib.decompressobj(31 if kind == "gzip" else 15)
        try:
            more = stream.decompress(data[at:], MAX_UNPACKED + 1 - len(out))
        except (zlib.error, OSError, EOFError):
            break
        out, ended = out + more, stream.eof
        if not ended or len(out) > MAX_UNPACKED:
            return out, len(data), ended
        at = len(data) - len(stream.unused_data)
    return out, at, ended


def _kind(magic: bytes) -> str:
    return {0x1F: "gzip", 0x42: "bzip2", 0x78: "zlib"}[magic[0]]


def _packed(data: bytes, path: tuple[str, ...], where, source: str) -> Iterator[Layer | Finding]:
    """What the compressed streams in data hold. A stream that breaks off is named so: its layer is only a part."""
    pos, view = 0, memoryview(data)
    while m := _PACKED.search(data, pos):
        kind = _kind(m[0])
        out, taken, ended = _stream(view[m.start() :], kind)
        pos = m.start() + taken if ended else m.start() + 1
        place, inner = where(m.start(), m.start() + taken), (*path, kind if ended else kind + "-part")
        if len(out) > MAX_UNPACKED:
            yield Finding("oversize_layer", ">".join((*path, kind)), *place, source)
            pos = len(data)
        elif out:
            yield from _packed(out, inner, lambda a, b, place=place: place, source)
            yield from _texts(out, inner, lambda a, b, place=place: place)


def _texts(data: bytes, path: tuple[str, ...], where) -> Iterator[Layer]:
    """The text that data is, or else its readable stretches."""
    text = _readable(data)
    for a, t in [(0, text)] if text else [(m.start(), m[0].decode()) for m in _STRETCH.finditer(data)]:
        at, spans, byte = [], [], a
        for i, c in enumerate(t):
            n = len(c.encode())
            span = (*where(byte, byte + n), False)
            if not spans or span != spans[-1]:
                at.append(i)
                spans.append(span)
            byte += n
        yield Layer(t, path, at, spans)


#: Escaped bytes and the bytes between them that need no escape: how, literal, pattern of a run, of a unit.
_ESCAPED = [
    ("url", "%", re.compile(r"[!-~]+"), re.compile(r"%([0-9A-Fa-f]{2})|(.)")),
    ("unicode", "\\", re.compile(r"(?:\\(?:x|u00)[0-9A-Fa-f]{2}|\\[abfnrtv0'\"\\/]|[ -\[\]-~])+"), re.compile(r"\\(?:x|u00)([0-9A-Fa-f]{2})|(\\?.)")),
]
_SHORT = {f"\\{a}": b for a, b in zip("abfnrtv0", b"\a\b\f\n\r\t\v\0", strict=True)}


def _escaped(layer: Layer) -> Iterator[Layer | Finding]:
    """Compressed streams whose bytes are percent or \\x escapes, as far as they need one."""
    for how, literal, runs, units in _ESCAPED:
        if literal not in layer.text:
            continue
        for m in runs.finditer(layer.text):
            if literal not in m[0]:
                continue
            found = list(units.finditer(m[0]))
            starts = [m.start() + x.start() for x in found] + [m.end()]
            data = bytes(int(x[1], 16) if x[1] else _SHORT.get(x[2], ord(x[2][-1])) for x in found)
            for d in [data, data.replace(b"+", b" ")] if how == "url" and b"+" in data else [data]:
                yield from _packed(d, (*layer.path, how), lambda a, b, starts=starts: layer.place(starts[a], starts[b]), m[0])


def _decoded(digits: str) -> bytes:
    return base64.b64decode(digits[: len(digits) - (len(digits) % 4 == 1)] + "=" * (-len(digits) % 4 % 3))


def _based(layer: Layer) -> Iterator[Layer | Finding]:
    """Base64, over line breaks too. What it is glued to may shift it, so each run is read from its first four digits on,
    and anew after each separator, which may end another word."""
    path = (*layer.path, "base64")
    for m in _BASE64.finditer(layer.text):
        run = m[0].rstrip("=")
        places = [m.start() + i for i, c in enumerate(run) if not c.isspace()] if any(c.isspace() for c in run) else range(m.start(), m.start() + len(run))
        plain = "".join(run.split())
        digits = plain.replace("-", "+").replace("_", "/")

        def where(a: int, b: int, first: int = 0, end: int | None = None, places=places) -> tuple[int, int]:
            # each byte comes from the digits that hold its bits
            last = min(first + -(-b * 8 // 6), len(places)) - 1
            return layer.place(places[min(first + a * 8 // 6, last)], places[last] + 1 if end is None or last < len(places) - 1 else end)

        seps = [x.end() for x in _SEPARATOR.finditer(plain)]
        shifted = [_decoded(digits[first:]) for first in range(4)]
        for first, data in enumerate(shifted):
            yield from _packed(data, path, lambda a, b, f=first: where(a, b, f, m.end()), m[0])
            yield from _texts(data, path, lambda a, b, f=first: where(a, b, f))
        for first, end in zip([0, *seps], [*(x - 1 for x in seps), len(plain)], strict=True):
            if end - first >= 14 and (first or end < len(plain)):
                yield from _texts(_decoded(digits[first:end]), path, lambda a, b, f=first: where(a, b, f))
            at = first // 4 * 3
            if first and (head := shifted[first % 4][at : at + PART_BYTES]).startswith(_BOUNDED) and (m2 := _STRETCH.match(head)):
                for rule, (_, pattern) in RULES.items():  # the byte before may be a letter, so that no word begins here
                    if k := pattern.match(m2[0].decode()):
                        yield Finding(rule, ">".join(path), *where(at, at + len(k["s"].encode()), first % 4), k["s"])


def scan(text: str) -> list[Finding]:
    """Findings of the text and of all layers under it, by place; of equal (rule, place) the shallowest layer's."""
    found: dict[tuple[str, int, int], Finding] = {}
    work, seen = deque([Layer(text, (), [0], [(0, len(text), True)])]), set()
    while work:
        layer = work.popleft()
        key = (hashlib.blake2b(layer.text.encode("utf-8", "replace"), digest_size=16).digest(), layer.spans[0][0], layer.spans[-1][1])
        if key in seen:
            continue
        seen.add(key)
        for rule, a, b in scan_layer(layer.text):
            start, end = layer.place(a, b)
            found.setdefault((rule, start, end), Finding(rule, ">".join(layer.path), start, end, layer.text[a:b]))
        if "%" in layer.text and (new := _replaced(layer, _PERCENT, "url", _percent)):
            work.append(new)
        if ("\\" in layer.text or "&#" in layer.text) and (new := _replaced(layer, _UNICODE, "unicode", _unicode)):
            work.append(new)
        for new in chain(_escaped(layer), _based(layer)):
            if isinstance(new, Layer):
                work.append(new)
            else:
                found.setdefault((new.rule, new.start, new.end), new)
    return sorted(found.values(), key=lambda f: (f.start, f.end, f.rule, f.path))


def redact(text: str) -> str | None:
    """The text with each found place as [SECRET]; None where there is none. Places that overlap become one."""
    found = scan(text)
    if not found:
        return None
    out, pos, held = [], 0, None
    for f in [*found, None]:
        if held and f and f.start < held[1]:
            held = held[0], max(held[1], f.end)
            continue
        if held:
            out += [text[pos : held[0]], "[SECRET]"]
            pos = held[1]
        held = f and (f.start, f.end)
    return "".join([*out, text[pos:]])


_OUT = pa.schema([("id", pa.int64()), ("rule", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret_sha256", pa.string())])


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule, path, start, end, secret_sha256), a row a finding: characters [start, end) of the original text.

    The secret itself isn't in the result, only its hash. Null and empty texts have no findings; repeated rows repeat
    theirs; a null id stays null; an empty table gives an empty result. Texts are scanned whole, whatever their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in text_slices(b, "x"):
                rows = [(i, f.rule, f.path, f.start, f.end, hashlib.sha256(f.secret.encode("utf-8", "replace")).hexdigest()) for i, x in zip(s.column("id").to_pylist(), s.column("x").to_pylist(), strict=True) for f in scan(x)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_OUT.types)], schema=_OUT)

    d = pick(docs, id=id_col, x=text_col).where("x is not null").select(F.col("id").cast("bigint"), "x")
    out = d.mapInArrow(run, "id bigint, rule string, path string, start bigint, end bigint, secret_sha256 string")
    return out.withColumnRenamed("id", id_col)


def redaction(text_col: str = "text"):
    """A Column: the text with its secrets as [SECRET]; null where it has none or is null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([x and redact(x) for x in a.to_pylist()], pa.string())

    return run.asNondeterministic()(F.col(text_col))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, secrets in their texts replaced by [SECRET]; n_chars, where there is one, follows
    the text. Null and empty texts stay as they are; an empty table stays empty."""
    d, at = positional(docs)
    text, length = at["text"], at.get("n_chars")
    new = d.withColumn("_new_", redaction(text))
    cols = {text: F.coalesce("_new_", text)}
    if length:
        cols[length] = F.when(F.col("_new_").isNull(), F.col(length)).otherwise(F.char_length("_new_"))
    return new.select(*[cols[c].cast(d.schema[c].dataType).alias(c) if c in cols else F.col(c) for c in d.columns]).toDF(*docs.columns)
