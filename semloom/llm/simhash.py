"""SimHash near-dedup over an LSH forest.

Fingerprint: 256 bits, each the sign of the sum of +-weight over a text's distinct folded words (weight: the word's
bytes, 8 at most, so that content words outweigh function words). Equal fingerprints are grouped first; the forest
holds each distinct fingerprint once.

Forest: `trees` tries, each over its own random permutation of the bits. A trie is kept as its sorted keys; a row in
a thin region climbs to shorter prefixes until its node would hold more than `leaf` fingerprints, one in a dense
region descends, but never below `deepest`, the depth at which all trees together still find a pair at `radius` with
probability `recall`. Depth and tree count follow from the number of distinct fingerprints.

A node is verified by exact distances: a row is linked to all within the radius, these take in what they reach, and the
triangle inequality tells what none of them can reach. So many near-equal prints cost one pass. A node that is still
too much work, or has too many rows for a task, is crowded: it is cut into blocks, and each two blocks are verified in a
task of their own, but for those that lie in one component already. So every node is verified whole, whatever its size.
Pairs become groups by connected components (large star, small star).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semloom.llm.common import checkpoint, fold, mix, n_shuffle, pick, positional, row_sums, span_hashes, text_bytes, text_slices, words

BITS = 256
WORDS = ["f0", "f1", "f2", "f3"]
RADIUS = 42
#: Of pairs that are exactly RADIUS apart; nearer ones are found more often.
RECALL = 0.95
LEAF = 64
#: Nodes of up to SMALL rows are compared pair by pair. A node is crowded beyond MOST_PAIRS comparisons (about 20 s) or
#: MOST_ROWS rows (56 bytes each).
SMALL, MOST_PAIRS, MOST_ROWS = 256, 4_000_000_000, 2_000_000
#: Rows of a crowded node's blocks, two of which meet in a task; rows of the node that meet each block first.
BLOCK, ANCHORS = 1 << 16, 64
#: The longest prefix.
KEY_BITS = 32


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint64 [row, 4]. A row without words has the mixed hash of all its bytes: equal texts still get equal bits."""
    f = fold(raw) if len(raw) else raw
    start, end, row = words(f, offsets)
    h, weight = span_hashes(f, start, end), np.minimum(end - start, 8).astype(np.int8)
    order = np.lexsort((h, row))
    h, row, weight = h[order], row[order], weight[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row, weight = h[first], row[first], weight[first]
    n = len(offsets) - 1
    out = np.zeros((n, 4), np.uint64)
    for k in range(4):
        bits = np.unpackbits(mix(h + np.uint64(k * 0x51ED2701)).view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
        sums = row_sums((2 * bits - 1) * weight[:, None], row, n)
        out[:, k] = np.packbits(sums > 0, axis=1).view(np.uint64)[:, 0]
    bare = np.flatnonzero(np.bincount(row, minlength=n) == 0)
    if len(bare):
        h = span_hashes(raw, offsets[bare], offsets[bare + 1])
        for k in range(4):
            out[bare, k] = mix(h + np.uint64(k * 0x51ED2701))
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _apart(cols: list[np.ndarray], a, b) -> np.ndarray:
    """distance() of rows a and b of prints that are held by column."""
    out = np.bitwise_count(cols[0][a] ^ cols[0][b]).astype(np.uint16)
    for c in cols[1:]:
        out += np.bitwise_count(c[a] ^ c[b])
    return out


def shared_prefix(depth: int, radius: int) -> float:
    """Chance that two fingerprints `radius` apart agree on `depth` random bits."""
    return math.comb(BITS - radius, depth) / math.comb(BITS, depth)


def forest_shape(n: int, radius: int = RADIUS, recall: float = RECALL, leaf: int = LEAF) -> tuple[int, int]:
    """(deepest, trees) for n distinct fingerprints: nodes of about `leaf` at the deepest level, and as many trees as
    the recall then needs."""
    deepest = min(KEY_BITS, max(8, math.ceil(math.log2(max(2, n) / leaf))))
    return deepest, trees_for(deepest, radius, recall)


def trees_for(deepest: int, radius: int, recall: float) -> int:
    """Trees that find a pair at the radius with probability recall when no prefix is longer than `deepest`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - shared_prefix(deepest, radius)))


def permutations(trees: int, seed: int = 20240229) -> np.ndarray:
    """[tree, KEY_BITS]: the bits that each tree's keys are made of."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(BITS)[:KEY_BITS] for _ in range(trees)])


def keys(fp: np.ndarray, perm: np.ndarray) -> np.ndarray:
    """int64 [row]: the permuted bits, most significant first."""
    out = np.zeros(len(fp), np.int64)
    for b in perm:
        out = out << 1 | ((fp[:, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)).astype(np.int64)
    return out


def nodes(key: np.ndarray, shortest: int, deepest: int, leaf: int) -> np.ndarray:
    """Node number of each sorted 32-bit key: the shortest prefix from `shortest` to `deepest` bits that holds at most
    `leaf` keys, or the one of `deepest` bits."""
    n = len(key)
    out = np.full(n, -1, np.int64)
    todo = np.arange(n)
    for depth in range(shortest, deepest + 1):
        if not len(todo):
            break
        prefix = key[todo] >> (32 - depth)
        new = np.r_[True, (prefix[1:] != prefix[:-1]) | (np.diff(todo) > 1)]
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        done = (size[run] <= leaf) if depth < deepest else np.ones(len(todo), bool)
        out[todo[done]] = todo[new][run[done]]
        todo = todo[~done]
    return out


def roots(fp: np.ndarray, node: np.ndarray, radius: int, most_pairs: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """(least index of the component of each row, whether its node is crowded); rows of a node within radius are linked.
    A crowded node has some of its links only."""
    cols = [np.ascontiguousarray(fp[:, k]) for k in range(4)]
    label, crowded = np.arange(len(fp)), np.zeros(len(fp), bool)
    size = np.bincount(node, minlength=len(fp))
    few = size[node]
    lag, at = 1, np.flatnonzero((few > 1) & (few <= SMALL))
    while len(at):
        at = at[(at + lag < len(fp))]
        at = at[node[at + lag] == node[at]]
        for cut in range(0, len(at), 1 << 17):
            a = at[cut : cut + (1 << 17)]
            hit = a[_apart(cols, a, a + lag) <= radius]
            hit = hit[label[hit] != label[hit + lag]]
            if len(hit):
                _link(label, hit, hit + lag)
        lag += 1
    for a in np.flatnonzero(size > SMALL):
        z = a + size[a]
        own, done = _reach([c[a:z] for c in cols], radius, most_pairs)
        label[a:z] = a + own
        crowded[a:z] = not done
    return label, crowded


def _reach(cols: list[np.ndarray], radius: int, most_pairs: float) -> tuple[np.ndarray, bool]:
    """(least index of each row's component, whether all were found within most_pairs comparisons).

    The first row left takes in all within the radius, and these, by their distance from it, what they reach of the rest:
    rows whose distances from it differ by more than the radius can't be within it of each other."""
    n, pairs = len(cols[0]), 0
    label, rest = np.arange(n), np.arange(n)
    while len(rest):
        pivot = rest[0]
        d = _apart(cols, pivot, rest).astype(np.int32)
        pairs += len(rest)
        near = d <= radius
        label[rest[near]] = pivot
        front, far, rest, apart = rest[near], d[near], rest[~near], d[~near]
        while len(front) and len(rest) and apart.min() <= far.max() + radius:
            order = np.argsort(-far, kind="stable")
            front, far, found = front[order], far[order], np.zeros(len(rest), bool)
            for at in range(0, len(front), 256):
                some, low, high = front[at : at + 256], far[at : at + 256].min() - radius, far[at] + radius
                cand = np.flatnonzero(~found & (apart >= low) & (apart <= high))
                if not len(cand) and apart.min() > high:
                    break
                pairs += len(cand) * len(some)
                if pairs > most_pairs:
                    label[rest[found]] = pivot
                    return label, False
                for cut in range(0, len(cand), 4096):
                    c = cand[cut : cut + 4096]
                    found[c] = (_apart(cols, some[:, None], rest[c][None]) <= radius).any(axis=0)
            front, far = rest[found], apart[found]
            label[front] = pivot
            rest, apart = rest[~found], apart[~found]
        if pairs > most_pairs:
            return label, not len(rest)
    return label, True


def _link(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of each a and b; label stays flat: label[label] == label."""
    a, b = label[a], label[b]
    while True:
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            return
        low, high = low[open_], high[open_]
        np.minimum.at(label, high, low)
        while True:
            flat = label[label]
            if np.array_equal(flat, label):
                break
            label[:] = flat
        a, b = label[low], label[high]


_FP = pa.schema([("id", pa.int64()), *((w, pa.int64()) for w in WORDS)])


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0..f3) of the rows whose id and text aren't null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in text_slices(b, "x"):
                fp = fingerprints(*text_bytes(s.column("x"))).view(np.int64)
                yield pa.record_batch([s.column("id"), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(4))], schema=_FP)

    d = pick(docs, id=id_col, x=text_col).where("id is not null and x is not null").select(F.col("id").cast("bigint"), "x")
    return d.mapInArrow(run, "id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")


def forest_edges(reps: DataFrame, deepest: int, trees: int, radius: int = RADIUS, leaf: int = LEAF, most_pairs: float = MOST_PAIRS, most_rows: int = MOST_ROWS) -> DataFrame:
    """(a, b, unit), b < a: edges that link the rows of reps (id, f0..f3, distinct) within radius which share a node of any
    tree; and (a, null, unit) for each row a of a crowded node, which unit names: its links are crowded_edges()'s to find.
    The shuffle carries a row a tree, 52 bytes; nodes of a tree's top prefix meet in one partition, sorted, and a task holds
    the rows of one, or of the part of one that no node crosses."""
    perms = permutations(trees, 20240229 + deepest)
    shortest, most = max(2, deepest - 6), max(most_rows, leaf)
    out = pa.schema([("g", pa.int64()), ("key", pa.int64()), *_FP])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                s = b.slice(at, 8192)
                fp = np.stack([s.column(w).to_numpy() for w in WORDS], axis=1).view(np.uint64)
                for t in range(trees):
                    key = keys(fp, perms[t])
                    yield pa.record_batch([pa.array((t << shortest) + (key >> (KEY_BITS - shortest))), pa.array(key), *(s.column(c) for c in ("id", *WORDS))], schema=out)

    def solve(part: pa.Table) -> pa.RecordBatch:
        g, key, ids = (part.column(c).to_numpy() for c in ("g", "key", "id"))
        fp = np.stack([part.column(w).to_numpy() for w in WORDS], axis=1).view(np.uint64)
        first = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
        node = np.concatenate([nodes(key[x:y], shortest, deepest, leaf) + x for x, y in zip(first[:-1], first[1:], strict=True)])
        label, crowded = roots(fp, node, radius, most_pairs)
        linked = np.flatnonzero(label != np.arange(len(label)))
        a, b = ids[linked], ids[label[linked]]
        return _found(np.maximum(a, b), np.minimum(a, b), ids[crowded], unit(g, key)[node[crowded]])

    def unit(g: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Name of a node by its first row: tree and key."""
        return g >> shortest << KEY_BITS | key

    def runs(part: pa.Table | pa.RecordBatch) -> np.ndarray:
        """Tree and longest prefix of each row, ascending."""
        return unit(part.column("g").to_numpy(), part.column("key").to_numpy()) >> (KEY_BITS - deepest)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch | pa.Table] = []
        rows, over, name = 0, None, 0  # over: the run that is a crowded node, name: its unit

        for batch in batches:
            if not batch.num_rows:
                continue
            if over is not None:
                cut = int(np.searchsorted(runs(batch), over, side="right"))
                yield _crowd(batch.slice(0, cut), name)
                if cut == batch.num_rows:
                    continue
                batch, over = batch.slice(cut), None
            g = batch.column("g").to_numpy()
            if held and held[-1].column("g")[-1].as_py() != g[0]:
                yield solve(_table(held))
                held, rows = [], 0
            cut = int(np.searchsorted(g, g[-1]))
            if cut:  # all groups but the last are whole
                yield solve(_table([*held, batch.slice(0, cut)]))
                held, rows = [], 0
            held.append(batch.slice(cut))
            rows += held[-1].num_rows
            if rows <= most:
                continue
            part = _table(held)
            run = runs(part)
            at = int(np.searchsorted(run, run[-1]))
            # a prefix that has rows before and after `at` has both runs there: if one of them exceeds a leaf, it is no node
            if at and max(rows - at, at - int(np.searchsorted(run, run[at - 1]))) > leaf:
                yield solve(part.slice(0, at))
                part, at = part.slice(at), 0
            held, rows = [part], part.num_rows
            if not at and rows > most:
                name = int(unit(part.column("g")[0].as_py(), part.column("key")[0].as_py()))
                yield _crowd(part, name)
                held, rows, over = [], 0, run[-1]
        if held:
            yield solve(_table(held))

    spark = reps.sparkSession
    rows = reps.select("id", *WORDS).mapInArrow(spread, "g bigint, key bigint, id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    met = rows.repartition(n_shuffle(spark), "g").sortWithinPartitions("g", "key", "id")
    return met.mapInArrow(join, "a bigint, b bigint, unit bigint").distinct()


def _found(a: np.ndarray, b: np.ndarray, crowded: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
    """Rows (a, b, null) and (crowded, null, unit)."""
    more = np.arange(len(a) + len(crowded)) >= len(a)
    return pa.record_batch([pa.array(np.r_[a, crowded]), pa.array(np.r_[b, crowded], mask=more), pa.array(np.r_[a, unit], mask=~more)], names=["a", "b", "unit"])


def _crowd(part: pa.Table | pa.RecordBatch, unit: int) -> pa.RecordBatch:
    none, ids = np.zeros(0, np.int64), part.column("id").to_numpy()
    return _found(none, none, ids, np.full(len(ids), unit, np.int64))


def _table(parts: list) -> pa.Table:
    return pa.concat_tables([p if isinstance(p, pa.Table) else pa.Table.from_batches([p]) for p in parts])


def links(reps: DataFrame, radius: int = RADIUS, recall: float = RECALL, leaf: int = LEAF, most_pairs: float = MOST_PAIRS, most_rows: int = MOST_ROWS, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that link the rows of reps (id, f0..f3, distinct) within radius which share a node."""
    deepest, trees = forest_shape(reps.count(), radius, recall, leaf)
    found = checkpoint(forest_edges(reps, deepest, trees, radius, leaf, most_pairs, most_rows))
    edges = found.where("b is not null").select("a", "b")
    crowded = found.where("b is null").select("unit", F.col("a").alias("id"))
    if not crowded.limit(1).count():
        return edges
    return edges.union(crowded_edges(crowded.join(reps, "id"), edges, radius, block))


def crowded_edges(rows: DataFrame, edges: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that, with those given, link all rows (unit, id, f0..f3) of a unit within radius.

    Blocks of about `block` rows are solved first, each with the same few rows of its unit, so that what is dense becomes
    one component. Then the components known by now make blocks of their own, the small ones together, and every two
    blocks of a unit are solved, except for two of one component. The work left is quadratic in a unit's unlinked rows."""
    size = rows.groupBy("unit").agg(F.ceil(F.count("*") / block).alias("blocks"))
    rows = checkpoint(rows.join(size, "unit").withColumn("x", F.expr("pmod(xxhash64(id), blocks)")))
    nth = F.row_number().over(Window.partitionBy("unit").orderBy(F.xxhash64("id", F.lit(1)), "id"))
    some = rows.where("blocks > 1").withColumn("_nth_", nth).where(F.col("_nth_") <= ANCHORS)
    some = some.select("unit", F.explode(F.expr("filter(sequence(0L, blocks - 1), y -> y <> x)")).alias("x"), "id", *WORDS)
    first = rows.select("unit", "x", "id", *WORDS).union(some).withColumn("y", F.col("x")).withColumn("label", F.col("id"))
    found = checkpoint(_solved(first, radius))
    many = rows.where("blocks > 1").select("unit", "id", *WORDS)
    if not many.limit(1).count():
        return found

    known = components(edges.union(found)).withColumnRenamed("root", "label")
    many = checkpoint(many.join(known, "id", "left").withColumn("label", F.coalesce("label", "id")))
    count = many.groupBy("unit", "label").agg(F.count("*").alias("n")).withColumn("own", F.col("n") >= block).withColumn("part", F.when(F.col("own"), F.col("label")).otherwise(0))
    whole = F.sum("n").over(Window.partitionBy("unit", "own", "part"))
    count = count.select("unit", "label", "own", "part", F.ceil(whole / block).alias("blocks"))
    many = checkpoint(many.join(count, ["unit", "label"]).withColumn("nth", F.expr("pmod(xxhash64(id, 2), blocks)")))
    key = ["unit", "own", "part", "nth"]
    at = checkpoint(many.select(key).distinct().withColumn("k", F.row_number().over(Window.partitionBy("unit").orderBy("own", "part", "nth"))))
    two = at.alias("p").join(at.alias("q"), F.expr("p.unit = q.unit and p.k <= q.k and not (p.own and q.own and p.part = q.part)"))
    two = checkpoint(two.select("p.unit", F.col("p.k").alias("x"), F.col("q.k").alias("y")))
    member = two.withColumn("k", F.explode(F.array_distinct(F.array("x", "y"))))
    again = many.join(at, key).select("unit", "k", "id", "label", *WORDS).join(member, ["unit", "k"])
    return found.union(checkpoint(_solved(again, radius)))


def _solved(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b), b < a: labels that a link within radius joins, of the rows (unit, x, y, id, label, f0..f3) of one unit, x and y."""

    def solve(part: pa.Table) -> pa.Table:
        label = part.column("label").to_numpy()
        root, _ = _reach([np.ascontiguousarray(part.column(w).to_numpy()).view(np.uint64) for w in WORDS], radius, math.inf)
        a, b = np.maximum(label, label[root]), np.minimum(label, label[root])
        e = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
        return pa.table({"a": e[:, 0], "b": e[:, 1]})

    key = ["unit", "x", "y"]
    tasks = rows.select(key).distinct().count()
    n = max(n_shuffle(rows.sparkSession), min(tasks, 10_000))  # a task's time is that of its comparisons, not of its bytes
    return rows.select(*key, "label", *WORDS).repartition(n, *key).groupBy(*key).applyInArrow(solve, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each connected component, for every id of edges (a, b) but the roots.

    Large star and small star in turn until no edge changes; a round shuffles the edges twice and is checkpointed."""
    cur = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = cur.union(cur.select("b", "a")).toDF("u", "v")
        low = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        large = both.select("u", "v", low.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = F.min("v").over(Window.partitionBy("u"))
        small = large.select("u", "v", low.alias("m"))
        nxt = checkpoint(small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", "e.m").toDF("a", "b").where("a <> b").distinct())
        # a forest of stars: every edge ends at a root, and each other vertex has one edge
        bad = nxt.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or nxt.alias("x").join(nxt.alias("y"), F.expr("x.b = y.a"), "left_semi").limit(1).count()
        cur = nxt
        if not bad:
            return cur.toDF("id", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """(id, group_id, keep) of every document: group_id is the least id of its group, keep holds for that one.

    A document without words (empty, punctuation only) groups with equal texts only. A null text is its own group and
    kept. Rows with a null id have no identity: they are left out. Of repeated ids one row comes out, with the group
    of its smallest fingerprint. An empty table gives an empty result. A text of any length counts whole."""
    fps = checkpoint(fingerprint_table(docs, id_col, text_col).groupBy("id").agg(F.min(F.struct(*WORDS)).alias("f")).select("id", "f.*"))
    reps = checkpoint(fps.groupBy(*WORDS).agg(F.min("id").alias("id")))
    linked = components(links(reps, radius, recall, leaf))
    by_rep = fps.join(reps.withColumnRenamed("id", "rep"), WORDS).select("id", "rep")
    grouped = by_rep.join(linked.toDF("rep", "root"), "rep", "left").select("id", F.coalesce("root", "rep").alias("group_id"))
    ids = pick(docs, id=id_col).where("id is not null").select(F.col("id").cast("bigint")).distinct()
    out = ids.join(grouped, "id", "left").withColumn("group_id", F.coalesce("group_id", "id"))
    return out.select(F.col("id").alias(id_col), "group_id", (F.col("id") == F.col("group_id")).alias("keep"))


#: Ids that a broadcast of the dropped documents may hold (8 MB); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group, with all its columns. Rows with a null id or text stay; of rows that
    repeat an id one stays, the one whose values as JSON come first; an empty table stays empty."""
    found = near_duplicates(docs)
    d, at = positional(docs)
    key = at["doc_id"]
    lost = checkpoint(found.where("not keep").select(F.col("doc_id").alias(key)))
    few = lost.count() <= BROADCAST_IDS
    kept = d.join(F.broadcast(lost) if few else lost, key, "left_anti").select(d.columns)
    again = checkpoint(d.groupBy(key).count().where(f"{key} is not null and count > 1").select(key))
    if not (n := again.count()):
        return kept.toDF(*docs.columns)
    some = F.broadcast(again) if n <= BROADCAST_IDS else again
    one = Window.partitionBy(key).orderBy(F.to_json(F.struct(*d.columns)))
    once = kept.join(some, key, "left_semi").select(d.columns).withColumn("_nth_", F.row_number().over(one)).where("_nth_ = 1").drop("_nth_")
    return kept.join(some, key, "left_anti").select(d.columns).union(once).toDF(*docs.columns)
