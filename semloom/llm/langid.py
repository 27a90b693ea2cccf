"""Language ID by cross-parsing entropy (Ziv-Merhav): one suffix automaton of labelled text per language.

A text is folded (lower case, runs of other characters one space) and parsed greedily into the longest pieces that
occur in a language's text. phrases * log2(training length) / bytes estimates the bits a byte costs in that language;
the language with the fewest wins. Blocks of a text are parsed side by side, each from a guessed start; then the parse of
the block before runs on into a block until both are in one state, from where on they agree. So a text of any length has
exactly the phrases of one unbroken parse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semloom.llm.common import checkpoint, comb, fold, pick, positional, text_bytes, text_slices

#: Folded byte -> byte to parse: digits and separators are spaces.
_SPACE = np.array([b if b > 57 else 32 for b in range(256)], np.uint8)


def squeeze(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all rows with runs of spaces as one and none at a row's start; new offsets."""
    x = _SPACE[fold(raw)] if len(raw) else raw
    keep = np.ones(len(x), bool)
    if len(x):
        space = x == 32
        keep[1:] = ~(space[1:] & space[:-1])
        at = offsets[:-1][offsets[:-1] < offsets[1:]]
        keep[at] = x[at] != 32
        keep[at[x[at] == 32]] = False
    kept = np.r_[0, np.cumsum(keep)]
    return x[keep], kept[offsets]


def suffix_automaton(seq: bytes) -> list[dict[int, int]]:
    """Transitions {symbol: state} of each state of the suffix automaton of seq; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


#: Bytes of a text that are parsed one after the other; more run side by side. No result depends on it.
BLOCK = 1024
#: Symbols between two looks at whether parses have met.
_STEPS = 16
_LOW = np.int64(0xFFFFFFFF)


class Model:
    """langs, and the automata of all languages in one table (see comb), about 1 MB a language: `roots` has the number of
    each one's root, `first` the state that each symbol leads to from there. A symbol that a language lacks leads from the
    root back to it; it is a phrase of its own, which doesn't depend on the parse and is counted apart."""

    def __init__(self, texts: dict[str, str]):
        self.langs, tables, self.roots, self.first, self.bits, size = [], [], [], [], [], 0
        for lang in sorted(texts):
            raw = np.frombuffer(texts[lang].encode("utf-8", "replace"), np.uint8)
            x, _ = squeeze(raw, np.array([0, len(raw)]))
            if not len(x):
                continue
            states = suffix_automaton(x.tobytes())
            states[0] = {c: states[0].get(c, 0) for c in range(256)}
            base, table = comb(states)
            base += size
            first = base[[states[0][c] for c in range(256)]]
            self.langs.append(lang)
            tables.append(np.where(table < 0, -1, table + (size << 32 | size)))
            self.roots.append(base[0])
            self.first.append(first)
            self.bits.append(np.log2(max(2, len(x))))
            size += len(table)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        self.roots, self.first = np.array(self.roots, np.int64), np.array(self.first, np.int64).reshape(-1, 256)

    def _step(self, state: np.ndarray, first: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after each symbol, whether it closed a phrase)."""
        v = self.table.take(state + sym, mode="clip")
        fails = v >> 32 != state
        return np.where(fails, first, v & _LOW), fails

    def phrases(self, raw: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """(phrases [row, language], parsed bytes of each row)."""
        x, off = squeeze(raw, offsets)
        size, n = np.diff(off), len(off) - 1
        out = np.zeros((n, len(self.langs)), np.int64)
        if not len(x) or not self.langs:
            return out, size
        blocks = -(-size // block)
        row = np.repeat(np.arange(n), blocks)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = off[row] + nth * block
        length = np.minimum(block, off[row + 1] - start)
        order = np.argsort(-length, kind="stable")
        state, count = self._parse(x, start[order], length[order])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        state, count = state[:, back], count[:, back]
        self._join(x, start, length, nth, state, count)
        last = np.flatnonzero(np.r_[nth[1:] == 0, True])
        count[:, last] += state[:, last] != self.roots[:, None]
        for j in range(len(self.langs)):
            alone = np.r_[0, np.cumsum((self.first[j] == self.roots[j]).take(x))]
            out[:, j] = np.bincount(row, weights=count[j], minlength=n) + alone[off[1:]] - alone[off[:-1]]
        return out, size

    def _parse(self, x: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last state, phrases closed) [language, block] of blocks, longest first, that each begin a phrase."""
        flat, row = self.first.ravel(), np.arange(len(self.langs))[:, None] << 8
        state = np.repeat(self.roots[:, None], len(start), axis=1)
        count = np.zeros(state.shape, np.int64)
        active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        for t, k in enumerate(active.tolist()):
            now, sym = state[:, :k], x.take(start[:k] + t, mode="clip").astype(np.int64)
            v = self.table.take(now + sym, mode="clip")
            fails = (v >> 32 != now).astype(np.int64)
            count[:, :k] += fails
            v &= _LOW
            # where one fails, the state after it from the root: by masks, as about half of them do
            new = flat.take(row + sym, mode="clip")
            new ^= v
            new &= np.negative(fails, out=fails)
            v ^= new
            state[:, :k] = v
        return state, count

    def _join(self, x: np.ndarray, start: np.ndarray, length: np.ndarray, nth: np.ndarray, state: np.ndarray, count: np.ndarray) -> None:
        """Carries each block's last state into the next block of its row, and what that changes there into count and
        state, both [language, block]. A block whose two parses don't meet has a new last state, which goes on to the block
        after it."""
        change = np.zeros(count.shape, np.int64)
        lang, to = np.nonzero(np.repeat(nth[None] > 0, len(self.langs), axis=0))
        ends = state.copy()
        while len(to):
            here = state[lang, to - 1] != self.roots[lang]
            change[lang, to] = 0
            back = lang[~here], to[~here]
            moved = [np.stack(back)[:, state[back] != ends[back]]]
            state[back] = ends[back]
            lang, to = lang[here], to[here]
            both = np.stack([state[lang, to - 1], self.roots[lang]])  # the parse that goes on, and the guessed one
            diff, t = np.zeros(len(to), np.int64), 0
            while len(to):
                left, at = length[to] - t, start[to] + t
                steps = min(_STEPS, int(left.max()))
                whole = int(left.min()) >= steps
                for i in range(steps):
                    sym = x.take(at + i if whole else at + np.minimum(i, left - 1)).astype(np.int64)
                    new, closed = self._step(both, self.first[lang, sym], sym)
                    more = closed[0].view(np.int8) - closed[1].view(np.int8)
                    both = new if whole else np.where(i < left, new, both)
                    diff += more if whole else np.where(i < left, more, 0)
                t += steps
                # parses that met go on alike: such a block ends as guessed, others at the block's end as they are
                met, over = both[0] == both[1], left <= steps
                end = np.where(met, ends[lang, to], both[0])
                done = met | over
                new = done & (state[lang, to] != end)
                moved.append(np.stack([lang[new], to[new]]))
                state[lang[new], to[new]] = end[new]
                change[lang[done], to[done]] = diff[done]
                lang, to, both, diff = lang[~done], to[~done], both[:, ~done], diff[~done]
            lang, to = np.concatenate(moved, axis=1)
            on = to + 1 < len(nth)
            lang, to = lang[on], to[on] + 1
            on = nth[to] > 0
            lang, to = lang[on], to[on]
        count += change

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits a byte [row, language], bytes)."""
        count, size = self.phrases(raw, offsets)
        return count * np.array(self.bits)[None, :] / np.maximum(size, 1)[:, None], size


#: Labels beyond which a column holds no languages, and rows of the sample's buckets (about 30 bytes each) to broadcast.
MOST_LANGS, BROADCAST_BUCKETS = 10_000, 200_000


def sample(docs: DataFrame, lang_col: str, text_col: str, id_col: str, train_chars: int) -> dict[str, str]:
    """train_chars characters of labelled texts per language, or all where there are fewer, in the order of a hash of the
    id; of the text that would pass the bound, the piece up to it.

    The driver gets no more than that: characters are first counted by hash bucket, and only the buckets that a
    language needs are read again."""
    d = pick(docs, i=id_col, x=text_col, l=lang_col).where("l is not null and x is not null").withColumn("n", F.length("x"))
    d = d.where(F.col("n") > 0).withColumn("h", F.xxhash64("i", "n")).withColumn("b", F.shiftrightunsigned("h", 44))
    d = d.withColumn("n", F.least("n", F.lit(train_chars))).withColumn("x", F.substring("x", 1, train_chars))
    by = Window.partitionBy("l")
    counts = d.groupBy("l", "b").agg(F.sum("n").alias("m"))
    before = F.coalesce(F.sum("m").over(by.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = counts.withColumn("before", before).where(F.col("before") < train_chars).select("l", "b")
    # at most a bucket a character of the bound and language, far fewer with texts of usual length
    need = checkpoint(need)
    if need.select("l").distinct().count() > MOST_LANGS:
        raise ValueError(f"{lang_col} has more than {MOST_LANGS} values")
    rows = d.join(F.broadcast(need) if need.count() <= BROADCAST_BUCKETS else need, ["l", "b"], "left_semi").withColumn("sum", F.sum("n").over(by.orderBy("b", "h", "i", "x").rowsBetween(Window.unboundedPreceding, 0)))
    texts: dict[str, list[str]] = {}
    room = train_chars - F.col("sum") + F.col("n")
    for r in rows.where(room > 0).select("l", "sum", F.substring("x", F.lit(1), room.cast("int")).alias("x")).collect():
        texts.setdefault(r["l"], []).append((r["sum"], r["x"]))
    return {k: " ".join(x for _, x in sorted(v)) for k, v in texts.items()}


RESULT = "lang string, bits double, margin double, n_bytes bigint, keep boolean"
_SLACK = 64
_ARROW = pa.struct([("lang", pa.string()), ("bits", pa.float64()), ("margin", pa.float64()), ("n_bytes", pa.int64()), ("keep", pa.bool_())])


def identify(df: DataFrame, model: Model, text_col: str = "text", max_bits: float = 4.0):
    """A Column for df: struct<lang, bits, margin, n_bytes, keep> of the text in text_col.

    lang: the language whose automaton parses the text into the fewest normalised phrases; ties go to the name that
    sorts first. bits: its score. margin: by how much the second language costs more. keep: false where no language
    parses the text in max_bits bits a byte, which holds for noise and unknown scripts and languages.
    Null, empty and letterless texts: lang, bits and margin null, n_bytes 0, keep false. Without any labelled text
    (an empty model): lang null, keep false."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for a in batches:
            parts = [_decide(m, s.column(0), max_bits) for s in text_slices(pa.record_batch([a], ["t"]), "t")]
            yield pa.concat_arrays(parts) if parts else pa.array([], _ARROW)

    return run.asNondeterministic()(F.col(text_col))  # evaluated once, even if a filter uses it


def _decide(m: Model, texts: pa.Array, max_bits: float) -> pa.Array:
    raw, off = text_bytes(texts)
    score, size = m.score(raw, off)
    n = len(size)
    if not m.langs:
        none = pa.nulls(n, pa.float64())
        return pa.StructArray.from_arrays([pa.nulls(n, pa.string()), none, none, pa.array(size), pa.array(np.zeros(n, bool))], fields=list(_ARROW))
    best = score.argmin(axis=1)
    low = score[np.arange(n), best]
    rest = score.copy()
    rest[np.arange(n), best] = np.inf
    second = rest.min(axis=1) if len(m.langs) > 1 else low
    blank = size == 0
    return pa.StructArray.from_arrays(
        [
            pa.DictionaryArray.from_arrays(pa.array(best.astype(np.int32), mask=blank), pa.array(m.langs)).cast(pa.string()),
            pa.array(low, mask=blank),
            pa.array(second - low, mask=blank),
            pa.array(size),
            pa.array(~blank & (low * size / (size + _SLACK) <= max_bits)),
        ],
        fields=list(_ARROW),
    )


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_chars: int = 30_000, max_bits: float = 4.0, model: Model | None = None) -> DataFrame:
    """(id, lang, bits, margin, n_bytes, keep) of every row of docs; see identify(). Repeated rows give repeated
    results, an empty table an empty one; a null id stays null. train_chars bounds the labelled text per language."""
    if model is None:
        model = Model(sample(docs, lang_col, text_col, id_col, train_chars))
    d = pick(docs, i=id_col, x=text_col)
    out = d.select("i", identify(d, model, "x", max_bits).alias("r"))
    return out.select(F.col("i").alias(id_col), "r.*")


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose text some language parses, with all their columns. Null, empty and letterless
    texts go; repeated rows and rows with a null id are judged like others; an empty table stays empty."""
    model = Model(sample(docs, "lang", "text", "doc_id", 30_000))
    d, at = positional(docs)
    kept = d.withColumn("_lid_", identify(d, model, at["text"])).where("_lid_.keep")
    return kept.drop("_lid_").toDF(*docs.columns)
