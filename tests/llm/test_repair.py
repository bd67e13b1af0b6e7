import hashlib
import itertools
import random
import re

import pytest

from voltide.llm import repair
from voltide.llm.queries import damaged_turns

TURNS = "conv_id bigint, turn bigint, role string, text string, kind string, copy int"


def plain(rows):
    """The cheapest edits of one conversation, by enumerating states forward with whole audits."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda z: (z[0] is not None, z[0] or 0, z[1], z[2]))
    seen, marks = set(), []
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for i, (_, role, text) in enumerate(rows):
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        mark = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marks.append(mark)
        if mark:
            counts[mark] += 1
        counts["illegal"] += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    turns = [t for t, _, _ in rows if t is not None]
    counts["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    best = {"": (0, "", ())}                          # by what was read last
    def grow(best):
        for _ in range(3):
            for last, (c, a, said) in list(best.items()):
                new = "a" if last == "u" else "u"
                option = (c + 2, a + "I", said + ({"u": "user:", "a": "assistant:"}[new],))
                if new not in best or option[:2] < best[new][:2]:
                    best[new] = option
        return best
    best = grow(best)
    for (_, role, text), mark in zip(rows, marks):
        after = {}
        def offer(last, option):
            if last not in after or option[:2] < after[last][:2]:
                after[last] = option
        for last, (c, a, said) in best.items():
            offer(last, (c + 3, a + "D", said))
            if mark in ("blank", "duplicate"):
                continue
            late = mark == "truncated"
            if (last, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                offer(role[:1], (c + late, a + "K", said + (f"{role}:{text}",)))
            new = "assistant" if last == "u" else "user"
            offer(new[0], (c + 2 + late, a + "R", said + (f"{new}:{text}",)))
        best = grow(after)
    cost, audit, said = min(best[k][:3] for k in ("", "a") if k in best)
    return counts | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(said).encode()).hexdigest()}, said


def cases():
    rng = random.Random(8)
    out = []
    for conv in [None, *range(60)]:
        for turn in range(rng.choice([0, 1, 2, 5, 9, 40])):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "useless"])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t", None, "Ünï? ", "a\x00b.", "x" * 50, f"{turn} said."])
            out.append((conv, rng.choice([turn] * 8 + [None, turn + 3, 2]), role, text, "k", 1))
    return out + [out[0], out[-1], out[-1]]


@pytest.mark.parametrize(("hold", "block"), [(1 << 22, 1 << 16), (0, 3), (400, 7), (0, 1)])
def test_equals_enumeration(spark, hold, block):
    rows = cases()
    turns = spark.createDataFrame(rows, TURNS).repartition(4)
    got = {r["conv_id"]: r.asDict() for r in repair.repair_report(turns, hold, block).collect()}
    groups = {c: [(t, r, x) for k, t, r, x, *_ in rows if k == c] for c in {r[0] for r in rows}}
    assert got.keys() == groups.keys()
    said = {}
    for r in repair.repaired_turns(turns, hold, block).orderBy("conv_id", "position").collect():
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, members in groups.items():
        want, lines = plain(members)
        assert {k: got[conv][k] for k in want} == want, (conv, members)
        assert tuple(said.get(conv, [])) == lines
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in lines))


def test_state_crosses_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        test_equals_enumeration(spark, 200, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair.repair_report(none).count() == 0 and repair.repaired_turns(none).count() == 0
    assert damaged_turns(none).count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?", "x", 9) for c, t in itertools.product(range(12), range(12))] + [(None, None, None, None, None, None)]
    want = []
    for c, t, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if kind:
            want += [(c, t, "user" if kind == 4 else role, {1: "", 2: "One Two Three"}.get(kind, text))] * (2 if kind == 3 else 1)
    key = lambda r: tuple(str(v) for v in r)
    got = [tuple(r) for r in damaged_turns(spark.createDataFrame(rows, TURNS)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
