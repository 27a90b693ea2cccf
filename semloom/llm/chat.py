"""Chat formatting into windows of a token budget.

A conversation's turns are rendered as <|role|> content <|end|> and encoded. Over the prefix sums of their token counts
each window takes the longest run of whole turns that fits: the system turn is kept in every window, then comes a
limited history, the latest turns of the window before, then new turns. The loss is on the assistant's tokens of new
turns only; repeated ones are masked, so over all windows every assistant token is a target exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semloom.llm.bpe import VOCABULARY, encoder
from semloom.llm.common import pick

BUDGET = 2048
HISTORY = 512
#: Ids behind the vocabulary's last one, in this order; a turn's role picks its opening.
SPECIAL = ("system", "user", "assistant", "other", "end")
MASKED = -100


class Window(NamedTuple):
    first: int  # the first turn after the system turn, by its place in the conversation; repeated from there to `new`
    new: int
    last: int
    skip: int  # tokens of turn `new` that windows before have had; 0 unless the turn alone is over the room
    take: int  # tokens of turn `last` in this window from `skip` on, or all
    system: int  # tokens of the system turn that the window begins with


def windows(counts: np.ndarray, system: bool, budget: int = BUDGET, history: int = HISTORY) -> list[Window]:
    """The windows over the token counts of a conversation's turns, the system turn (if any) at 0.

    Every window begins with the system turn as long as that leaves a sixteenth of the budget. A longer system turn comes
    first, cut into windows of its own, and every window after them begins with its first budget // 2 tokens.

    History never crowds out a new turn: its oldest turns go until the next turn fits. A turn that doesn't fit in a
    window of its own is cut, the only case of a window that ends within a turn; its pieces go without history."""
    total = np.concatenate([[0], np.cumsum(counts)])  # total[j] - total[i]: tokens of turns i to j - 1
    n, out, kept = len(counts), [], 0
    if system:
        kept = int(counts[0])
        if kept + max(1, budget // 16) > budget:
            out += [Window(0, 0, 0, skip, min(budget, kept - skip), 0) for skip in range(0, kept, budget)]
            kept = budget // 2
        elif n == 1:
            return [Window(1, 1, 0, 0, 0, kept)]
    at = origin = int(bool(system))
    room = budget - kept
    while at < n:
        if counts[at] > room:
            for skip in range(0, int(counts[at]), room):
                out.append(Window(at, at, at, skip, min(room, int(counts[at]) - skip), kept))
            at += 1
            continue
        first = max(origin, int(np.searchsorted(total, total[at] - history)))
        first = max(first, int(np.searchsorted(total, total[at + 1] - room)))  # else the next turn wouldn't fit
        end = int(np.searchsorted(total, total[first] + room, side="right")) - 1
        out.append(Window(first, at, end - 1, 0, int(counts[end - 1]), kept))
        at = end
    return out


_SCHEMA = "conv_id bigint, window int, first_turn bigint, new_turn bigint, last_turn bigint, n_tokens int, n_targets int, tokens array<int>, targets array<int>"


def render(roles: list[str | None], texts: pa.Array, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of all turns one after the other, whether each is the assistant's own, number of each turn's tokens)."""
    e = encoder(path)
    special = {r: len(e.ranks) + k for k, r in enumerate(SPECIAL)}
    end, other = special.pop("end"), special["other"]
    ids, n = e.encode_all(texts)
    size = n + 2
    stop = np.cumsum(size)
    tokens, own = np.empty(stop[-1] if len(stop) else 0, np.int32), np.repeat(np.array([r == "assistant" for r in roles], bool), size)
    inner = np.ones(len(tokens), bool)
    inner[stop - size] = inner[stop - 1] = False
    tokens[inner] = ids
    tokens[stop - size], tokens[stop - 1] = [special.get(r, other) for r in roles], end
    own[stop - size] = False
    return tokens, own, size


#: Bytes of conversations that are rendered at once; a longer conversation comes alone.
STEP_BYTES = 1 << 20


def _steps(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[np.ndarray], pa.Array, list, np.ndarray]]:
    """(ids, turn numbers, texts, roles, turns' ends) of runs of conversations of about STEP_BYTES."""
    lists = b.column("turns")
    off = lists.offsets.to_numpy().astype(np.int64)
    turns = lists.values.slice(off[0], off[-1] - off[0])
    off -= off[0]
    _, number, role, text = turns.flatten()
    size = np.r_[0, np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))][off]
    ids, at = b.column("conv_id").to_numpy(), 0
    while at < len(ids):
        end = max(at + 1, int(np.searchsorted(size, size[at] + STEP_BYTES, side="right")) - 1)
        cut = slice(off[at], off[end])
        yield ids[at:end], number[cut].to_pylist(), text[cut], role[cut].to_pylist(), off[at : end + 1] - off[at]
        at = end


def _windows(ids: np.ndarray, number: list, texts: pa.Array, roles: list, off: np.ndarray, budget: int, history: int, path: str) -> pa.RecordBatch:
    tokens, own, size = render(roles, texts, path)
    start = np.r_[0, np.cumsum(size)]
    rows, picked, mine = [], [], []
    for conv, a, z in zip(ids.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
        for k, w in enumerate(windows(size[a:z], roles[a] == "system", budget, history)):
            some = w.last >= w.first
            head = tokens[start[a] : start[a] + w.system]
            x = start[a + w.first] + (w.skip if w.first == w.new else 0)
            y = start[a + w.last] + (w.skip if w.last == w.new else 0) + w.take if some else x
            new = own[x:y].copy()
            new[: start[a + w.new] - x if w.new > w.first else 0] = False
            picked += [head, tokens[x:y]]
            mine += [np.zeros(len(head), bool), new]
            rows.append((conv, k, *((number[a + i] for i in (w.first, w.new, w.last)) if some else (None,) * 3), len(head) + len(new), int(new.sum())))
    flat, mask = np.concatenate(picked), np.concatenate(mine)
    cuts = pa.array(np.r_[0, np.cumsum([r[5] for r in rows])].astype(np.int32))
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()])]
    lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (flat, np.where(mask, flat, MASKED).astype(np.int32))]
    return pa.RecordBatch.from_arrays([*columns, *lists], names=[c.split()[0] for c in _SCHEMA.split(", ")])


def chat_windows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY, path: str = VOCABULARY) -> DataFrame:
    """(conv_id, window, first_turn, new_turn, last_turn, n_tokens, n_targets, tokens, targets), a row a window.

    tokens holds the system turn, then turns first_turn to last_turn, of which those before new_turn are repeated;
    targets has the token where the loss is on it, else -100. A conversation of a system turn alone has one window with
    null turns. Only a system turn that comes first is kept in every window (see windows() for one that is too long);
    later ones are turns like others.

    Turns go by number, then role, then text; a null number comes after all others. Turns with a null text are left
    out, exact repeats of a turn too; an empty text is a turn of no content. A null or unknown role is rendered as
    <|other|> and is no target. Rows with a null conversation id belong to none and are left out; an empty table gives
    an empty result. Texts of any length are encoded whole."""
    if budget < 16 or not 0 <= history < budget:
        raise ValueError("budget must be 16 at least, history less than it")
    d = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id is not null and text is not null")
    # the order key has a flag first, as nulls sort first
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    turns = F.array_sort(F.array_distinct(F.collect_list(turn)))
    d = d.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(turns.alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for step in _steps(b):
                yield _windows(*step, budget, history, path)

    return d.mapInArrow(run, _SCHEMA).withColumnRenamed("conv_id", conv_col)
