"""Best-fit packing by hierarchical residuals.

Items (a text's tokens; a text over the capacity is cut into full pieces and a rest) are packed best-fit decreasing
within hash buckets. Bins that are nearly full are done. The underfull ones become items themselves: `fan_in` buckets
merge into one and best-fit runs again over whole bins, up the tree until one bucket is left, whose bins all are done.

What goes up is bounded. Best fit leaves a bucket one bin of at most half the capacity, since two would have been one,
and bins over the half never merge with each other. So each level has at most one bin a bucket that could fill another
one: that bin and the `fan_in` emptiest of the others go up, the rest can't be bettered and are done, too. A bucket of any
level thus gets at most fan_in * (fan_in + 1) bins. A level is checkpointed in the shared folder, so a lost executor costs
no earlier level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semloom.llm import bpe
from semloom.llm.common import checkpoint, n_shuffle, pick

CAPACITY = 4096
TOKEN_BYTES = 4
FAN_IN = 8
NEARLY = 0.98
BUCKET_ITEMS = 20_000


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item, in the given order: the bin with the least room that is enough, the latest of equal ones."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, out = 0, 0, []
    for s in sizes:
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r, b, bins = capacity, bins, bins + 1
        out.append(b)
        if r > s:
            room[r - s].append(b)
            mask |= 1 << (r - s)
    return out


def tokens(text: Column | str) -> Column:
    """Estimated tokens: one for TOKEN_BYTES bytes, rounded up."""
    return F.ceil(F.octet_length(text) / TOKEN_BYTES)


#: Copies of a document that one array lists.
_STEP = 10_000
_ROWS = "bucket bigint, bin string, doc_id bigint, copy int, part bigint, size int, slot int, offset int, fill int, done boolean"


def _closed(fill: np.ndarray, capacity: int, least: int, fan_in: int) -> np.ndarray:
    """Whether each bin is done: it is nearly full, or over half full and not among the fan_in emptiest of those."""
    done = fill >= least
    big = np.flatnonzero(~done & (2 * fill > capacity))
    done[big[np.argsort(fill[big], kind="stable")[fan_in:]]] = True
    return done


def _level(capacity: int, least: int, fan_in: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(pdf["bin"])
        size = np.bincount(code, weights=pdf["size"]).astype(int)
        order = np.lexsort((names, -size))
        place = np.empty(len(size), np.int64)
        place[order] = best_fit(size[order].tolist(), capacity)
        first = pd.Series(names[order]).groupby(place[order], sort=True).first().to_numpy()  # a bin has its largest item's name
        fill = np.bincount(place, weights=size).astype(np.int32)
        done = _closed(fill, capacity, least, fan_in)
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size))
        at = place[code]
        out = pdf.assign(bin=first[at], fill=fill[at], done=done[at])
        out = out.iloc[np.lexsort((pdf["slot"], rank[code], at))]
        group = out.groupby("bin", sort=False)
        return out.assign(slot=group.cumcount().astype(np.int32), offset=(group["size"].cumsum() - out["size"]).astype(np.int32))

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, capacity: int = CAPACITY, fan_in: int = FAN_IN, nearly: float = NEARLY, bucket_items: int = BUCKET_ITEMS) -> DataFrame:
    """(bin_id, slot, offset, doc_id, copy, start, size, fill): `size` tokens of a document from its token `start` on
    lie in the bin from `offset` on; `fill` is the bin's total, at most capacity.

    Sizes are size_col's, or estimated from the text's bytes (see tokens). Null or empty texts and sizes below 1 have
    nothing to pack and don't come out. Repeated ids are told apart by copy (0, 1, ..., the shortest first); rows with a
    null id are packed too, with copy over all of them. Of equal sizes the name id-copy-part that sorts first is packed
    first; of bins with equal room the latest is taken. An empty table gives an empty result."""
    spark = docs.sparkSession
    if size_col:
        d = pick(docs, id=id_col, n=size_col).select("id", F.col("n").cast("bigint").alias("n"))
    else:
        d = pick(docs, id=id_col, x=text_col).select("id", tokens("x").alias("n"))
    d = d.where("n > 0").select(F.col("id").cast("bigint").alias("doc_id"), "n")
    # equal rows are counted before they meet, so that an id (or null) which a large part of the rows has is no hot spot
    earlier = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    d = d.groupBy("doc_id", "n").agg(F.count("*").alias("c")).withColumn("b", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    d = d.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("c") - 1, F.lit(_STEP))))
    d = d.select("doc_id", "n", F.explode(F.sequence(F.col("b") + F.col("s"), F.col("b") + F.least(F.col("c"), F.col("s") + _STEP) - 1)).alias("copy"))
    last = F.ceil(F.col("n") / capacity) - 1
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    size = F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("int")
    items = checkpoint(d.select(F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "copy", "part").alias("bin"), "doc_id", F.col("copy").cast("int").alias("copy"), "part", size.alias("size")))
    buckets = max(1, -(-items.count() // bucket_items))
    zero = F.lit(0).cast("int")
    rows = items.select(F.pmod(F.xxhash64("bin"), F.lit(buckets)).alias("bucket"), "bin", "doc_id", "copy", "part", "size", zero.alias("slot"), zero.alias("offset"), zero.alias("fill"), F.lit(False).alias("done"))
    over = []
    while True:
        least = 0 if buckets == 1 else int(nearly * capacity)
        out = rows.repartition(min(buckets, n_shuffle(spark)), "bucket").groupBy("bucket").applyInPandas(_level(capacity, least, fan_in), _ROWS)
        if buckets == 1:
            over.append(out)
            break
        out = checkpoint(out)
        over.append(out.where("done"))
        buckets = -(-buckets // fan_in)
        rows = out.where("not done").withColumn("bucket", F.floor(F.col("bucket") / fan_in))
    packed = over[0]
    for o in over[1:]:
        packed = packed.union(o)
    return packed.select(F.col("bin").alias("bin_id"), "slot", "offset", F.col("doc_id").alias(id_col), "copy", (F.col("part") * capacity).alias("start"), "size", "fill")


def pack_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """pack() by the tokens that the encoder gives each text, so that start, size and fill are places in its ids."""
    return pack(bpe.count(docs, id_col, text_col), id_col, size_col="n_tokens", capacity=capacity)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: where each kept document lies in the packed sequences, by the encoder's tokens; see pack().
    Null and empty texts have no place, repeated ids and null ids are told apart by copy, columns with other or clashing
    names don't matter, and an empty table gives an empty result."""
    return pack_tokens(docs)
