"""Chat formatting: a cheapest legal sequence of turns, found by dynamic programming, then rendered."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import stored

#: States of the automaton: the role of the last turn put out.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
#: An optional system turn, then user and assistant in turn; a conversation ends with the assistant.
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Empty turns between a state and a turn of the given role, where that needs some.
FILL = {(START, ASSISTANT): [USER], (SYSTEM, ASSISTANT): [USER], (USER, USER): [ASSISTANT], (ASSISTANT, ASSISTANT): [USER]}
CLOSE = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
MERGE, RELABEL, INSERT, NEVER = 1, 2, 3, 1 << 40
#: Rows of a conversation that one task repairs at once, and blocks that one task combines.
BITS = 12


@cache
def moves(role: int) -> tuple[np.ndarray, dict]:
    """Cost and action of taking a turn of a role (0: unknown) from state s to state t; of equal costs, append before insert before merge."""
    cost, action = np.full((4, 4), NEVER, np.int64), {}
    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            change = RELABEL * (role != t)
            ways = []
            if (s, t) in LEGAL:
                ways.append((change, "append", []))
            if (s, t) in FILL:
                ways.append((change + INSERT * len(FILL[s, t]), "append", FILL[s, t]))
            if s == t:
                ways.append((change + MERGE, "merge", []))
            if ways:
                cost[s, t], *rest = min(ways, key=lambda w: w[0])
                action[s, t] = rest
    return cost, action


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product over (min, +)."""
    return np.minimum((a[:, :, None] + b[None]).min(1), NEVER)


def product(steps: list[np.ndarray]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for x in steps:
        out = times(out, x)
    return out


def path(steps: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """A cheapest sequence of states from entry to leave, both included; of equal ones the smallest earlier states, from the end."""
    seen = [np.where(np.arange(4) == entry, 0, NEVER)]
    for x in steps:
        seen.append(np.minimum((seen[-1][:, None] + x).min(0), NEVER))
    out = [leave]
    for k in range(len(steps) - 1, -1, -1):
        out.append(int((seen[k] + steps[k][:, out[-1]]).argmin()))
    return out[::-1]


def ending(matrix: np.ndarray) -> int:
    """The cheapest last state from START, the closing insertions counted."""
    return int((matrix[START] + np.array([INSERT * len(CLOSE[s]) for s in range(4)])).argmin())


def _matrices(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(m, np.int64).reshape(4, 4) for m in pdf["m"]]


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each row of rows (columns conv_id, turn, role, text): the action, the role put out and the rendered piece.

    Out: conv_id, turn, role, text as given, pos, action (append or merge), out_role,
    inserted (roles of the empty turns before), cost (of this turn, closing turns
    included) and piece; the pieces of a conversation in order of pos make its rendering.
    pos follows turn, then role, then the hash of the text; it is no count.
    A role is compared without case and outer blanks; an unknown or null one is relabelled,
    which costs as any relabelling. A null text is empty, a null conv_id is a conversation
    of its own, a null turn comes first, and repeated rows are turns of their own.

    A conversation may hold any share of all rows. Rows are sorted into ranges once, and
    cut into blocks of 2**BITS rows at most. Costs of the automaton form a (min, +)
    matrix product, which is associative: each block gives one 4 by 4 matrix, blocks are
    combined in a tree of that fan-in, and the states at the blocks' borders come down it.
    The blocks hold codes alone; texts, which may be long, meet their row's head and tail
    in a join on pos.
    """
    role = F.lower(F.trim(F.col("role")))
    code = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES[1:])), role), F.lit(0)).cast("int")
    conv = F.when(F.col("conv_id").isNull(), "none").otherwise(F.concat(F.lit("id "), F.col("conv_id").cast("string")))  # pandas makes doubles of longs beside a null
    own = rows.select("conv_id", "turn", "role", "text", conv.alias("conv"), code.alias("code"), F.xxhash64("text").alias("salt"))
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = own.repartitionByRange(n, "conv_id", "turn", "role", "salt").sortWithinPartitions("conv_id", "turn", "role", "salt").drop("salt")
    own = stored(own.withColumn("pos", F.monotonically_increasing_id()).withColumn("block", F.shiftright("pos", BITS)), "turns")

    def costs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out = [(c, pdf.block.iloc[0], product([moves(r)[0] for r in g.code]).ravel().tolist()) for c, g in pdf.groupby("conv", sort=False)]
        return pd.DataFrame(out, columns=["conv", "block", "m"])

    shape = "conv string, block long, m array<long>"
    levels = [stored(own.select("conv", "pos", "code", "block").groupBy("block").applyInPandas(costs, shape), "costs")]

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({"conv": pdf.conv.iloc[:1], "block": pdf.up.iloc[:1], "m": [product(_matrices(pdf)).ravel().tolist()]})

    def many(level: DataFrame) -> DataFrame:
        return level.groupBy("conv").count().filter("count > 1").select("conv")

    while not (open_ := many(levels[-1])).isEmpty():
        split = levels[-1].join(open_, "conv", "left_semi").withColumn("up", F.shiftright("block", BITS))
        up = split.groupBy("conv", "up").applyInPandas(combine, shape)
        levels.append(stored(up, "costs"))

    def tops(level: DataFrame, above: DataFrame | None) -> DataFrame:
        """Entry and last state of conversations that are whole in this level."""
        if above is not None:
            level = level.join(above.select("conv").distinct(), "conv", "left_anti")

        def run(batches):
            for x in batches:
                yield pd.DataFrame({"conv": x.conv, "block": x.block, "entry": START, "leave": [ending(m) for m in _matrices(x)], "last": True})

        return level.mapInPandas(run, borders)

    borders = "conv string, block long, entry int, leave int, last boolean"

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        states = path(_matrices(pdf), int(pdf.entry.iloc[0]), int(pdf.leave.iloc[0]))
        last = [False] * (len(pdf) - 1) + [bool(pdf["last"].iloc[0])]
        return pd.DataFrame({"conv": pdf.conv, "block": pdf.block, "entry": states[:-1], "leave": states[1:], "last": last})

    found = None
    for k in range(len(levels) - 1, -1, -1):
        whole = tops(levels[k], levels[k + 1] if k + 1 < len(levels) else None)
        if found is not None:
            parent = found.select("conv", F.col("block").alias("up"), "entry", "leave", "last")
            inner = levels[k].withColumn("up", F.shiftright("block", BITS)).join(parent, ["conv", "up"])
            whole = whole.unionByName(inner.groupBy("conv", "up").applyInPandas(down, borders))
        found = stored(whole, "borders")

    joined = own.select("conv", "pos", "code", "block").join(found.select("conv", "block", "entry", "leave", "last"), ["conv", "block"])

    def render(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("pos"), []
        for _, g in pdf.groupby("conv", sort=False):
            given = g.code.tolist()
            states = path([moves(r)[0] for r in given], int(g.entry.iloc[0]), int(g.leave.iloc[0]))
            for k, row in enumerate(g.pos):
                s, t = states[k], states[k + 1]
                cost, (action, added) = moves(given[k])[0][s, t], moves(given[k])[1][s, t]
                closing = CLOSE[t] if k == len(g) - 1 and g["last"].iloc[0] else None
                out.append((row, action, ROLES[t], [ROLES[x] for x in added], int(cost) + INSERT * len(closing or []), *around(s, t, action, added, closing)))
        return pd.DataFrame(out, columns=["pos", "action", "out_role", "inserted", "cost", "head", "tail"])

    made = joined.groupBy("block").applyInPandas(render, "pos long, action string, out_role string, inserted array<string>, cost long, head string, tail string")
    piece = F.concat("head", F.coalesce("text", F.lit("")), "tail")
    return own.select("conv_id", "turn", "role", "text", "pos").join(made, "pos").select("conv_id", "turn", "role", "text", "pos", "action", "out_role", "inserted", "cost", piece.alias("piece"))


def head(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


def around(before: int, role: int, action: str, added: list[int], closing: list[int] | None) -> tuple[str, str]:
    """What a turn adds to the rendering before and after its text; a turn's end is written by what comes after it, or by the closing."""
    end = "<|end|>\n"
    if action == "merge":
        first = "\n\n"
    else:
        first = (end if before != START else "") + "".join(head(x) + end for x in added) + head(role)
    return first, "" if closing is None else end + "".join(head(x) + end for x in closing)
