import itertools
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import chat

COLUMNS = "conv_id long, turn long, role string, text string, cost string"


def cheapest(codes):
    """All sequences of put-out roles, priced by the rules as they are told: relabelling 2, merging into a turn of the same role 1, each empty turn 3."""
    best = None
    for given in itertools.product((1, 2, 3), repeat=len(codes)):
        cost, last = sum(2 for r, t in zip(codes, given, strict=True) if r != t), None
        for t in given:
            if t == 1:  # a system turn stands at the start alone, or merges into one
                cost += 0 if last is None else 1 if last == 1 else 10**6
            elif t == 2:  # after a user's turn it merges, or an empty answer comes between
                cost += 1 if last == 2 else 0
            else:  # an answer follows a user's turn; after another answer merging is cheaper than a turn between
                cost += 0 if last == 2 else 1 if last == 3 else 3
            last = t
        cost += {1: 6, 2: 3, 3: 0}[last]
        best = cost if best is None else min(best, cost)
    return best


def legal(rendered):
    roles = [x.split("|>")[0] for x in rendered.split("<|")[1:] if x.split("|>")[0] != "end"]
    if roles[0] == "system":
        roles = roles[1:]
    return roles == ["user", "assistant"] * (len(roles) // 2) and rendered.count("<|end|>") == rendered.count("<|") // 2


@pytest.mark.parametrize("bits", [12, 1])
def test_cost_is_least_and_order_legal(spark, monkeypatch, bits):
    monkeypatch.setattr(chat, "BITS", bits)
    r, rows = random.Random(3), []
    for conv in range(25):
        for turn in range(r.randrange(1, 8)):
            rows.append((conv, turn, r.choice(["user", "assistant", "System ", "tool", None, "ASSISTANT"]), r.choice(["a", "", None, "b\nc"]), "x"))
    rows += [(None, None, None, None, None), (None, None, None, None, None), (None, 1, "user", "q", None)]
    got = chat.repaired(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()
    assert len(got) == len(rows)
    for conv in {x[0] for x in rows}:
        own = sorted((x for x in got if x.conv_id == conv), key=lambda x: x.pos)
        assert [-1 if x.turn is None else x.turn for x in own] == sorted(-1 if x.turn is None else x.turn for x in own)
        codes = [["system", "user", "assistant"].index(c) + 1 if (c := (x.role or "").strip().lower()) in chat.ROLES[1:] else 0 for x in own]
        assert sum(x.cost for x in own) == cheapest(codes)
        assert legal("".join(x.piece for x in own))


def test_clean_conversation_stays(spark):
    rows = [(1, 0, "system", "s", ""), (1, 1, "user", "u", ""), (1, 2, "assistant", "a", "")]
    got = chat.repaired(spark.createDataFrame(rows, COLUMNS))
    assert got.agg(F.sum("cost")).first()[0] == 0
    assert "".join(x.piece for x in got.orderBy("turn").collect()) == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n"


def test_empty_table(spark):
    assert chat.repaired(spark.createDataFrame([], COLUMNS)).count() == 0


def test_ties_have_one_order_whatever_the_partitions(spark):
    r = random.Random(5)
    rows = [(1, 0, "user", f"text {r.random()}" * r.randrange(1, 40), "") for _ in range(600)] + [(1, 1, "assistant", "x" * 100_000, "")]
    seen = set()
    for n in (1, 7):
        got = chat.repaired(spark.createDataFrame(rows, COLUMNS).repartition(n)).orderBy("pos").collect()
        seen.add("".join(x.piece for x in got))
        assert [x.text for x in got[:-1]] != sorted(x.text for x in got[:-1]) and got[-1].turn == 1
    assert len(seen) == 1
