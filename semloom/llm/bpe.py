"""Byte-level BPE by dynamic programming over prefixes.

For each prefix of a piece of text its encoding's last token is unique: of the vocabulary's tokens that end the prefix,
the one whose pair with the last token of the rest is itself the encoding of the two tokens' bytes. So one token per
prefix holds the encodings of all prefixes: an append goes on from the last one, and an edit keeps those before it.
An automaton of all tokens lists those that end at each byte, longest first. Words and pieces are kept once encoded.
Many new pieces go through the same program side by side, a byte of all of them at a time (class Side).
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.common import comb, pick, text_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text into the pieces that tokens never cross: contractions, words, numbers, other runs, white space.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that an encoder keeps of pieces and of words; then it starts anew. They only save time.
KEEP = 300_000
#: Words, and tokens of words, that a store keeps, likewise.
KEEP_WORDS, KEEP_TOKENS = 400_000, 2_000_000
#: Bytes of texts that are encoded at once: the more, the fewer words are looked up again and the more new ones go together.
STEP_BYTES = 1 << 22


def load(path: str) -> dict[bytes, int]:
    """Ranks by token from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no token for the bytes {missing}")
        self.ranks, self.bytes = ranks, {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        #: right token -> left token -> whether they are compatible; learned_fits counts what is kept
        self.fits: dict[int, dict[int, bool]] = {}
        self.learned_fits = 0
        self.ending = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.fits[rank] = {}
            self.ending.add_word(token.decode("latin-1"), (len(token), rank, self.fits[rank].get))
        self.ending.make_automaton()
        self.halves = {r: self._halves(b) for b, r in ranks.items()}
        self.split = regex.compile(pattern)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words = _Words(self)
        self.store = _Store(self)
        self.side: Side | None = None

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte, or where its merges lead elsewhere."""
        parts = self.merged(token, self.ranks[token])
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def merged(self, data: bytes, below: int = 1 << 60) -> list[int]:
        """The encoding by definition: merge the pair of least rank (below a bound), the leftmost of equal ones, until
        none is left."""
        parts, get = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > 1:
            found = [get(a + b, below) for a, b in zip(parts, parts[1:], strict=False)]
            rank = min(found)
            if rank >= below:
                break
            i = found.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes is [a, b].

        It isn't if some merge across their border comes before the merges that make a and b at that border. Undo
        those one after the other, the later first: a's right half or b's left half is then what meets the border."""
        ok = self.fits[b].get(a)
        if ok is None:
            if self.learned_fits >= 4 * KEEP:
                for known in self.fits.values():
                    known.clear()
                self.learned_fits = 0
            ok = self.fits[b][a] = self._compatible(a, b)
            self.learned_fits += 1
        return ok

    def _compatible(self, a: int, b: int) -> bool:
        before = 1 << 60  # a merge across the border that comes before this one spoils the pair
        while True:
            if self.ranks.get(self.bytes[a] + self.bytes[b], 1 << 60) < before:
                return False
            left, right = self.halves[a], self.halves[b]
            # at equal ranks the leftmost pair is merged first, so b's merge waits for one across the border
            if left and (not right or a > b):
                a, before = left[1], a
            elif right:
                b, before = right[0], b + 1
            else:
                return True

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """last[i] is the last token of data[: i + 1]; goes on from the prefixes it has to all of data."""
        want, compatible, append = len(last), self.compatible, last.append
        at = max(0, want - self.longest)
        for end, (n, token, fits) in self.ending.iter(data[at:].decode("latin-1")):
            if end + at != want:  # it has its token already
                continue
            before = want - n
            if before >= 0:
                ok = fits(last[before])
                if not ok and (ok is False or not compatible(last[before], token)):
                    continue
            append(token)
            want += 1
        return last

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding that the prefixes' last tokens spell."""
        out, i = [], len(data)
        while i:
            out.append(last[i - 1])
            i -= len(self.bytes[last[i - 1]])
        return out[::-1]

    def piece(self, s: str) -> tuple[int, ...]:
        """The encoding of one piece."""
        found = self.pieces.get(s)
        if found is None:
            data = s.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            found = (whole,) if whole is not None else tuple(self.tokens(data, self.extend(data, [])))
            if len(self.pieces) >= KEEP:
                self.pieces.clear()
            if len(s) <= 64:
                self.pieces[s] = found
        return found

    def _parts(self, text: str) -> Iterable[tuple[int, ...]]:
        """Ids of the text, some at a time."""
        if "  " in text or _ODD.search(text):  # spaces beside other white space: the pieces depend on the whole run
            parts = map(self.piece, self.split.findall(text))
        else:  # else a piece starts at each space, so words with the space before them are looked up
            first, *rest = text.split(" ")
            parts = chain([tuple(chain.from_iterable(map(self.piece, self.split.findall(first))))], map(self.words.__getitem__, rest))
            if len(self.words) > KEEP:
                self.words.clear()
        return parts

    def encode(self, text: str) -> np.ndarray:
        """int32 ids of the text."""
        return np.fromiter(chain.from_iterable(self._parts(text)), np.int32)

    def count(self, text: str) -> int:
        """Number of the text's ids."""
        return sum(map(len, self._parts(text)))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of each text's ids, 0 of a null."""
        return self._numbered(texts, False)[1]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(int32 ids of all texts one after the other, number of each text's ids); a null has none."""
        return self._numbered(texts, True)

    def _numbered(self, texts: pa.Array, spell: bool) -> tuple[np.ndarray, np.ndarray]:
        """Words are split and numbered by Arrow, so each distinct one is looked up once; their ids are gathered by numpy."""
        odd = pc.fill_null(pc.match_substring_regex(texts, _ODD_RE2), False).to_numpy(zero_copy_only=False)
        count, ids, store = np.zeros(len(texts), np.int64), np.zeros(0, np.int32), self.store
        plain = np.flatnonzero(~odd & texts.is_valid().to_numpy(zero_copy_only=False))
        if len(plain):
            lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
            off = lists.offsets.to_numpy()[:-1]
            flat = lists.flatten().dictionary_encode()
            store.trim()
            known = store.numbers(flat.dictionary.to_pylist())
            word = known[flat.indices.to_numpy()]
            # the first word has no space before it
            word[off] = store.numbers([(w,) for w in flat.take(pa.array(off)).cast(texts.type).to_pylist()])
            ids, size = store.ids(word, spell)
            count[plain] = np.add.reduceat(size, off)
        rest = {}
        for i in np.flatnonzero(odd):
            store.trim()
            rest[int(i)] = store.ids(store.pieces_of(self.split.findall(texts[int(i)].as_py())), True)[0]
        for i, own in rest.items():
            count[i] = len(own)
        if rest and spell:
            out = np.empty(count.sum(), np.int32)
            at = np.cumsum(count) - count
            out[_spread(at[plain], count[plain])] = ids
            for i, own in rest.items():
                out[at[i] : at[i] + len(own)] = own
            ids = out
        return ids, count

    def spell_many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of each one's ids)."""
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.array([len(d) for d in data], np.int64)
        short = np.flatnonzero((size > 0) & (size <= Side.LONGEST))
        count, parts = np.zeros(len(data), np.int64), {}
        self.side = self.side or Side(self)
        ids, count[short] = self.side.encode([data[i] for i in short])
        for i in np.flatnonzero(size > Side.LONGEST):
            parts[i] = self.piece(pieces[i])
            count[i] = len(parts[i])
        if parts:
            out, at = np.empty(count.sum(), np.int32), np.cumsum(count) - count
            out[_spread(at[short], count[short])] = ids
            for i, own in parts.items():
                out[at[i] : at[i] + len(own)] = own
            ids = out
        return ids, count

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_ODD = regex.compile(r"[^\S ] | [^\S ]| \Z|\A ")
#: The same and two spaces, in the words of Arrow's expressions, whose \s is ASCII's.
_SPACE = r"[\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD_RE2 = rf"{_SPACE} | {_SPACE}|  | \z|\A "


class _Words(dict):
    """Word without the space before it -> ids of both, as they are first asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> tuple[int, ...]:
        e = self.encoder
        found = tuple(chain.from_iterable(map(e.piece, e.split.findall(" " + word))))
        if len(word) <= 64:
            self[word] = found
        return found

    def __reduce__(self):
        return (_Words, (self.encoder,))


class _Store:
    """Numbers of words and pieces; the ids of number i are tokens[start[i] : start[i] + size[i]]. A word stands without
    the space before it, as a tuple where it has none."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.words: dict[str | tuple[str], int] = {}
        self.pieces: dict[str, int] = {}
        self.tokens, self.start, self.size = array("i"), array("q"), array("i")

    def numbers(self, words: list) -> np.ndarray:
        get = self.words.get
        out = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if len(new := np.flatnonzero(out < 0)):
            out[new] = self._add([words[i] for i in new])
        return out

    def _add(self, words: list) -> np.ndarray:
        split, parts = self.encoder.split.findall, []
        for w in words:
            if isinstance(w, tuple):
                parts.append(split(w[0]))
            elif w.isascii() and w.isalpha():
                parts.append((" " + w,))
            elif w.isascii() and w[:-1].isalpha() and w[-1] in ",.;:!?":
                parts.append((" " + w[:-1], w[-1]))
            else:
                parts.append(split(" " + w))
        number = self.pieces_of(list(chain.from_iterable(parts)))
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.cumsum(count) - count
        out = np.empty(len(words), np.int64)
        one = count == 1
        out[one] = number[at[one]]  # a word of one piece has its number
        more = np.flatnonzero(~one)
        if len(more):
            ids, size = self.ids(number[_spread(at[more], count[more])], True)
            first = np.cumsum(count[more]) - count[more]
            total = np.r_[0, np.cumsum(size)]
            out[more] = self._keep(ids, total[first + count[more]] - total[first])
        self.words.update(zip(words, out.tolist(), strict=True))
        return out

    def pieces_of(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece."""
        get = self.pieces.get
        out = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        if len(at := np.flatnonzero(out < 0)):
            new = list(dict.fromkeys(pieces[i] for i in at))
            self.pieces.update(zip(new, self._keep(*self.encoder.spell_many(new)).tolist(), strict=True))
            out[at] = [get(pieces[i]) for i in at]
        return out

    def _keep(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        first = len(self.start)
        self.start.frombytes((len(self.tokens) + np.cumsum(size) - size).astype(np.int64).tobytes())
        self.size.frombytes(size.astype(np.int32).tobytes())
        self.tokens.frombytes(ids.astype(np.int32).tobytes())
        return np.arange(first, first + len(size))

    def ids(self, numbers: np.ndarray, spell: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbers one after the other, number of each one's ids)."""
        size = np.array(self.size, np.int64)[numbers]
        return (np.array(self.tokens, np.int32)[_spread(np.array(self.start, np.int64)[numbers], size)] if spell else np.zeros(0, np.int32)), size

    def trim(self) -> None:
        if len(self.words) > KEEP_WORDS or len(self.pieces) > KEEP_WORDS or len(self.tokens) > KEEP_TOKENS:
            self.__init__(self.encoder)


class _Pairs:
    """Small integers by pair of tokens, in one open hash table; both sides are arrays."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        """Values, -1 where a pair isn't there."""
        slot, out, open_ = self._slot(key), np.full(len(key), -1, np.int32), np.arange(len(key))
        while len(open_):
            there = self.keys[slot]
            hit = there == key[open_]
            out[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            open_, slot = open_[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def put(self, key: np.ndarray, value: np.ndarray) -> None:
        """Adds pairs that aren't there, each once."""
        slot, open_ = self._slot(key), np.arange(len(key))
        self.n += len(key)
        while len(open_):
            free = np.flatnonzero(self.keys[slot] < 0)
            self.keys[slot[free]] = key[open_[free]]
            lost = self.keys[slot] != key[open_]  # the slot was taken, by one of these too
            done = ~lost
            self.values[slot[done]] = value[open_[done]]
            open_, slot = open_[lost], (slot[lost] + 1) & (len(self.keys) - 1)


class Side:
    """The prefix program over many pieces side by side. A trie of all tokens follows each place where a token may begin."""

    #: Bytes of the longest piece that goes this way.
    LONGEST = 64

    def __init__(self, e: Encoder):
        rows, token = [{}], [-1]
        for data, rank in e.ranks.items():
            at = 0
            for c in data:
                nxt = rows[at].get(c)
                if nxt is None:
                    nxt = rows[at][c] = len(rows)
                    rows.append({})
                    token.append(-1)
                at = nxt
            token[at] = rank
        base, self.table = comb(rows)
        self.root = int(base[0])
        self.token = np.full(int(base.max()) + 1, -1, np.int32)
        self.token[base] = token
        n = max(e.bytes) + 1
        self.size = np.zeros(n, np.int32)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        merges = {}
        for rank, data in e.bytes.items():
            self.size[rank] = len(data)
            if half := e.halves[rank]:
                self.left[rank], self.right[rank] = half
            for i in range(1, len(data)):
                a, b = e.ranks.get(data[:i]), e.ranks.get(data[i:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = rank
        self.merges = _Pairs(max(8, (2 * len(merges)).bit_length()))
        self.merges.put(np.fromiter(merges, np.int64, len(merges)), np.fromiter(merges.values(), np.int32, len(merges)))
        self.fits = _Pairs(21)

    def compatible(self, key: np.ndarray) -> np.ndarray:
        """Whether each pair left << 32 | right is the encoding of its bytes; see Encoder.compatible."""
        out = self.fits.get(key)
        if len(new := np.flatnonzero(out < 0)):
            fresh = np.unique(key[new])
            if self.fits.n + len(fresh) > len(self.fits.keys) // 2:
                self.fits = _Pairs(max(21, (4 * len(fresh)).bit_length()))
            self.fits.put(fresh, self._compatible(fresh).astype(np.int32))
            out[new] = self.fits.get(key[new])
        return out > 0

    def _compatible(self, key: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(key), bool), np.arange(len(key))
        a, b, before = key >> 32, key & 0xFFFFFFFF, np.full(len(key), 1 << 60)
        while len(at):
            rank = self.merges.get(a << 32 | b)
            ok = (rank < 0) | (rank >= before)
            at, a, b, before = at[ok], a[ok], b[ok], before[ok]
            down = (self.right[a] >= 0) & ((self.left[b] < 0) | (a > b))
            up = ~down & (self.left[b] >= 0)
            out[at[~down & ~up]] = True
            before = np.where(down, a, b + 1)
            a, b = np.where(down, self.right[a], a), np.where(up, self.left[b], b)
            on = down | up
            at, a, b, before = at[on], a[on], b[on], before[on]
        return out

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, number of each one's ids); pieces of 1 to LONGEST bytes."""
        n = len(pieces)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        length = np.fromiter(map(len, pieces), np.int64, n)
        order = np.argsort(-length, kind="stable")
        size = length[order]
        most = int(size[0])
        rows = np.repeat(np.arange(n), length)
        byte = np.zeros((most, n), np.int64)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        byte[np.arange(len(rows)) - np.repeat(np.cumsum(length) - length, length), place[rows]] = np.frombuffer(b"".join(pieces), np.uint8)
        last = np.zeros((most, n), np.int64)
        active = np.searchsorted(-size, -np.arange(1, most + 1), side="right")
        who, begin, state = (np.zeros(0, np.int64),) * 3
        for i in range(most):
            k = active[i]
            on = who < k
            who = np.concatenate([who[on], np.arange(k)])
            begin = np.concatenate([begin[on], np.full(k, i)])
            state = np.concatenate([state[on], np.full(k, self.root)])
            v = self.table.take(state + byte[i, who])
            on = v >> 32 == state
            who, begin, state = who[on], begin[on], v[on] & 0xFFFFFFFF
            token = self.token[state]
            whole = np.flatnonzero((token >= 0) & (begin == 0))
            some = np.flatnonzero((token >= 0) & (begin > 0))
            fits = some[self.compatible(last[begin[some] - 1, who[some]] << 32 | token[some])]
            last[i, who[fits]] = token[fits]
            last[i, who[whole]] = token[whole]
        out, at = [], np.arange(n)
        end = size.copy()
        while len(at):
            t = last[end[at] - 1, at]
            out.append((at, t))
            end[at] -= self.size[t]
            at = at[end[at] > 0]
        count = np.bincount(np.concatenate([a for a, _ in out]), minlength=n)
        ids, stop = np.empty(count.sum(), np.int32), np.cumsum(count[place])
        stop = stop[order]
        for step, (a, t) in enumerate(out):
            ids[stop[a] - 1 - step] = t
        return ids, count[place]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Text:
    """A text that is kept encoded while it changes. Each piece holds the last token of each of its prefixes."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.parts: list[tuple[str, list[int]]] = []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts new in place of text[start:end]. Pieces before the edit stay, the first changed one keeps the prefixes
        it shares with its old form, and pieces after it stay from where the old and new ones fall together again."""
        text = self.text[:start] + new + self.text[end:]
        at, k = 0, 0
        while k < len(self.parts) and at + len(self.parts[k][0]) < start:  # one that ends at the edit may grow
            at += len(self.parts[k][0])
            k += 1
        while k and start - at < 2:  # white space before the edit may split otherwise
            k -= 1
            at -= len(self.parts[k][0])
        ends, pos = {}, 0
        for j, (piece, _) in enumerate(self.parts):
            ends[pos] = j
            pos += len(piece)
        kept, old = self.parts[:k], self.parts[k:]
        shift, pos = len(text) - len(self.text), at
        for m in self.encoder.split.finditer(text, at):
            j = ends.get(pos - shift)
            if pos >= start + len(new) + 1 and j is not None and j >= k:
                kept += self.parts[j:]
                break
            piece, last = m[0], []
            if old and pos == at:
                a, b = old[0][0].encode(), piece.encode()
                same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                last = old[0][1][:same]
            kept.append((piece, self.encoder.extend(piece.encode(), last)))
            pos = m.end()
        self.parts, self.text = kept, text

    def ids(self) -> list[int]:
        return [t for piece, last in self.parts for t in self.encoder.tokens(piece.encode(), last)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str = VOCABULARY, pattern: str = PIECES) -> Encoder:
    """One encoder a process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(load(path), pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = PIECES) -> DataFrame:
    """(id, tokens array<int>, n_tokens) of every row of docs. An empty text has an empty array, a null text null in
    both columns. Repeated rows repeat their result, a null id stays null, an empty table gives an empty result. Texts
    are encoded whole; a piece of any length takes time in proportion to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            for s in text_slices(b, "x", STEP_BYTES):
                x = s.column("x")
                null = x.is_null().to_numpy(zero_copy_only=False)
                ids, n = e.encode_all(x)
                cuts = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32), mask=np.r_[null, False])
                yield pa.record_batch([s.column("id"), pa.ListArray.from_arrays(cuts, pa.array(ids)), pa.array(n.astype(np.int32), mask=null)], names=["id", "tokens", "n_tokens"])

    d = pick(docs, id=id_col, x=text_col).select(F.col("id").cast("bigint"), "x")
    return d.mapInArrow(run, "id bigint, tokens array<int>, n_tokens int").withColumnRenamed("id", id_col)


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = PIECES) -> DataFrame:
    """(id, n_tokens) of every row of docs, as encode() has them, without the tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            for s in text_slices(b, "x", STEP_BYTES):
                x = s.column("x")
                n = pa.array(e.counts(x).astype(np.int32), mask=x.is_null().to_numpy(zero_copy_only=False))
                yield pa.record_batch([s.column("id"), n], names=["id", "n_tokens"])

    d = pick(docs, id=id_col, x=text_col).select(F.col("id").cast("bigint"), "x")
    return d.mapInArrow(run, "id bigint, n_tokens int").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """(id, text) of every row; null tokens give a null text, and bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            text = [x if x is None else e.decode(x).decode("utf-8", "replace") for x in b.column("x").to_pylist()]
            yield pa.record_batch([b.column("id"), pa.array(text, pa.string())], names=["id", "text"])

    d = pick(encoded, id=id_col, x=tokens_col).select(F.col("id").cast("bigint"), "x")
    return d.mapInArrow(run, "id bigint, text string").withColumnRenamed("id", id_col)
