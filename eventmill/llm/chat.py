"""Minimum-cost role repair of conversations, and their rendering.

Legal turns are an automaton: a conversation may begin with ``system``, then ``user`` and
``assistant`` alternate, ``assistant`` last. A dynamic program over its states chooses for
each turn the cheapest of: keep it; merge it into the message before it, which has its
role; relabel it; put an empty message before it. A conversation that ends elsewhere gets
empty messages at its end.

Rows are sorted by range over (conversation, turn), so one conversation of any length
spreads over partitions. Segments of at most ``SEGMENT`` turns get a matrix of costs from
entry to exit state; the matrices are combined in a stream for the costs at which each
segment is entered. With these each segment knows for each exit the entry of the cheapest
path, which a stream from the end chains; then each segment is repaired for itself. The
result has one row per turn with the piece of rendered text that the turn adds, so no
conversation is gathered whole.

Defined results: turns are in the order of ``turn``, nulls last, repeated turns by role and
text; roles are folded in case and known aliases; an unknown or null role must be
relabelled; a null text counts as empty; rows with a null conversation form one
conversation; repeated rows are turns like others. Of equally cheap repairs the one whose last
turn has the earliest role of system, user, assistant is taken, then whose turn before it has,
and so on, however turns are cut into segments. ``<|`` inside a text is rendered as ``< |``,
so that no text can make a turn. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from eventmill.plans.scratch import materialize
from eventmill.plans.skew import partitions

SEGMENT = 512
ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
START, SYSTEM, USER, ASSISTANT = range(4)

#: Empty messages needed between two states; a state that is missing cannot follow.
_GAP: dict[tuple[int, int], tuple[int, ...]] = {
    (START, SYSTEM): (),
    (START, USER): (),
    (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (),
    (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (),
    (ASSISTANT, USER): (),
}
#: Empty messages at the end.
CLOSE: dict[int, tuple[int, ...]] = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def state_of(role: str | None) -> int:
    """The state that a role's own message leads to; START if it is unknown."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else START


def _moves(role: int) -> list[tuple[int, int, float]]:
    """(from, to, cost), cheapest form of each."""
    out = []
    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            cost = 0.0 if t == role else RELABEL
            if s == t:
                out.append((s, t, cost + MERGE))
            elif (s, t) in _GAP:
                out.append((s, t, cost + INSERT * len(_GAP[s, t])))
    return out


_TABLE = {r: _moves(r) for r in range(4)}
_MATRIX = np.full((4, 4, 4), np.inf)
for _r, _ms in _TABLE.items():
    for _s, _t, _c in _ms:
        _MATRIX[_r, _s, _t] = _c


def transfer(roles: list[int]) -> np.ndarray:
    """Least cost from each entry to each exit state."""
    whole = np.where(np.eye(4) > 0, 0.0, np.inf)
    for r in roles:
        whole = (whole[:, :, None] + _MATRIX[r][None]).min(1)
    return whole


def _back(roles: list[int], cost: np.ndarray) -> list[np.ndarray]:
    """For each turn the best state before it by the state after it, entered at ``cost`` by state; ties go to the earlier role."""
    back = []
    for r in roles:
        step = cost[:, None] + _MATRIX[r]
        back.append(step.argmin(0))
        cost = step.min(0)
    return back


def entries(roles: list[int], cost: np.ndarray) -> list[int]:
    """The state in which the cheapest path to each exit state enters."""
    at = np.arange(4)
    for b in reversed(_back(roles, cost)):
        at = b[at]
    return at.tolist()


def repair(roles: list[int], cost: np.ndarray, leave: int) -> list[int]:
    """States after each turn on the cheapest path to ``leave``."""
    states, t = [], leave
    for b in reversed(_back(roles, cost)):
        states.append(t)
        t = int(b[t])
    return states[::-1]


def _close(state: int) -> float:
    return INSERT * len(CLOSE[state])


def _header(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


END = "<|end|>\n"


def render(before: int, state: int, text: str, last: bool) -> tuple[str, list[str]]:
    """The piece that a turn adds, and the roles of empty messages in it."""
    put: tuple[int, ...] = ()
    text = text.replace("<|", "< |")
    if before == state:
        piece = "\n\n" + text
    else:
        put = _GAP[before, state]
        piece = (END if before != START else "") + "".join(_header(p) + END for p in put) + _header(state) + text
    if last:
        put = (*put, *CLOSE[state])
        piece += END + "".join(_header(p) + END for p in CLOSE[state])
    return piece, [ROLES[p - 1] for p in put]


def _groups(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of equal keys in sorted batches; a run may go over the end of a batch."""
    held: list[pd.DataFrame] = []
    key: tuple | None = None
    for b in batches:
        if not len(b):
            continue
        rows = list(zip(*(b[k] for k in keys)))
        cuts = [0, *(k for k in range(1, len(rows)) if rows[k] != rows[k - 1]), len(rows)]
        for a, z in zip(cuts, cuts[1:]):
            if key is not None and rows[a] != key:
                yield key, pd.concat(held) if len(held) > 1 else held[0]
                held = []
            key = rows[a]
            held.append(b.iloc[a:z])
    if key is not None:
        yield key, pd.concat(held) if len(held) > 1 else held[0]


def _by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """Rows dealt by ``keys`` into a stated number of partitions, since Python's time does not show in their size."""
    return df.repartition(partitions(df), *keys).sortWithinPartitions(*keys, *order)


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """``conv_id, turn, role, new_role, action, inserted, rendered`` of every turn."""
    rows = turns.select(
        F.coalesce(F.col(conv).cast("string"), F.lit("\x00")).alias("key"),
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = ["key", F.col("turn").isNull(), "turn", F.col("role").isNull(), "role", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    sorted_rows = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "turns")
    # ``at`` is unique and follows the order, also over partitions: a segment is a stretch of it
    cut = sorted_rows.withColumn("seg", F.floor(F.col("at") / segment))

    def costs(batches):
        for b in _groups(batches, "key", "seg"):
            (key, seg), part = b
            yield pd.DataFrame({"key": [key], "seg": [seg], "cost": [transfer([state_of(r) for r in part["role"]]).ravel().tolist()]})

    def joined(make):
        def run(batches):
            held = []
            for d in make(batches):
                held.append(d)
                if len(held) >= 2000:
                    yield pd.concat(held)
                    held = []
            if held:
                yield pd.concat(held)

        return run

    matrices = materialize(_by(cut.select("key", "seg", "at", "role"), ["key", "seg"], "at").mapInPandas(joined(costs), "key string, seg long, cost array<double>"), "costs")

    def forward(batches):
        for b in batches:
            out = []
            for key, seg, cost in zip(b["key"], b["seg"], b["cost"]):
                if key != forward.key:
                    forward.key, forward.x = key, np.array([0.0, np.inf, np.inf, np.inf])
                out.append(forward.x.tolist())
                forward.x = (forward.x[:, None] + np.array(cost).reshape(4, 4)).min(0)
            yield b[["key", "seg"]].assign(ahead=out)

    def forth(batches):
        forward.key, forward.x = None, None
        yield from forward(batches)

    ahead = materialize(_by(matrices, ["key"], "seg").mapInPandas(forth, "key string, seg long, ahead array<double>"), "ahead")

    def entered(batches):
        for (key, seg), part in _groups(batches, "key", "seg"):
            cost = np.array(part["ahead"].iloc[0])
            roles = [state_of(r) for r in part["role"]]
            leave = int(((cost[:, None] + transfer(roles)).min(0) + [_close(s) for s in range(4)]).argmin())
            yield pd.DataFrame({"key": [key], "seg": [seg], "entries": [entries(roles, cost)], "best": [leave]})

    known = cut.select("key", "seg", "at", "role").join(ahead.select("key", "seg", "ahead"), ["key", "seg"])
    starts = materialize(_by(known, ["key", "seg"], "at").mapInPandas(joined(entered), "key string, seg long, entries array<int>, best int"), "entries")

    def back(batches):
        key, t = None, START
        for b in batches:
            out = []
            for k, seg, entry, best in zip(b["key"], b["seg"], b["entries"], b["best"]):
                last = k != key
                if last:
                    key, t = k, int(best)
                s = int(entry[t])
                out.append((k, seg, s, t, last))
                t = s
            yield pd.DataFrame(out, columns=["key", "seg", "entry", "leave", "last"])

    ends = _by(starts, ["key"], F.desc("seg")).mapInPandas(back, "key string, seg long, entry int, leave int, last boolean")
    ends = ends.join(ahead.select("key", "seg", "ahead"), ["key", "seg"])

    def told(batches):
        for (_, _), part in _groups(batches, "key", "seg"):
            roles = [state_of(r) for r in part["role"]]
            entry, leave, last = int(part["entry"].iloc[0]), int(part["leave"].iloc[0]), bool(part["last"].iloc[0])
            states = repair(roles, np.array(part["ahead"].iloc[0]), leave)
            before = [entry, *states[:-1]]
            pieces = [render(b, s, t, last and k == len(states) - 1) for k, (b, s, t) in enumerate(zip(before, states, part["text"]))]
            yield pd.DataFrame(
                {
                    "at": part["at"].to_numpy(),
                    "new_role": [ROLES[s - 1] for s in states],
                    "action": ["+".join(["relabel"] * (s != r) + ["merge"] * (b == s)) or "keep" for b, s, r in zip(before, states, roles)],
                    "inserted": [",".join(p) for _, p in pieces],
                    "rendered": [p for p, _ in pieces],
                }
            )

    parts = cut.select("key", "seg", "at", "role", "text").join(ends, ["key", "seg"])
    done = _by(parts, ["key", "seg"], "at").mapInPandas(joined(told), "at long, new_role string, action string, inserted string, rendered string")
    return sorted_rows.select("at", "conv_id", "turn", "role").join(done, "at").select("conv_id", "turn", "role", "new_role", "action", "inserted", "rendered", F.col("at").alias("position"))
