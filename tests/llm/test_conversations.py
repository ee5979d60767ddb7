import hashlib
import itertools
import random
import re
import zlib

import pytest

from gleanery.llm.conversations import damaged, repair, repaired_turns, steps, turns_of

LEGAL = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    out = []
    for i, (role, text) in enumerate(rows):
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not marks else "duplicate" if (role, text) in rows[:i] else "truncated" if marks[-1] not in ".!?" else "none")
    return out


def cheapest(rows):
    """The least (cost, audit) over all edits and all insertions that cost no more than to delete everything."""
    kinds, best = faults_of(rows), (2 * len(rows), "D" * len(rows))
    for edits in itertools.product("KRrD", repeat=len(rows)):
        if any(e != "D" and k in ("blank", "duplicate") for e, k in zip(edits, kinds)):
            continue
        cost = sum({"K": 0, "R": 1, "r": 1, "D": 2}[e] + 5 * (e != "D" and k == "truncated") for e, k in zip(edits, kinds))
        marks = [{"K": (r + " ")[0], "R": "u", "r": "a", "D": ""}[e] for e, (r, _) in zip(edits, rows)]
        for n in range(max(-1, (best[0] - cost) // 5) + 1):
            for gaps in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for fill in itertools.product("ua", repeat=n):
                    more = ["".join(f for g, f in zip(gaps, fill) if g == i) for i in range(len(rows) + 1)]
                    if LEGAL.fullmatch("".join(x + y for x, y in zip(more, [*marks, ""]))):
                        best = min(best, (cost + 5 * n, "".join("I" * len(x) + y.upper() for x, y in zip(more, [*edits, ""]))))
    return best


def by_brute_force(rows, harm=True):
    """conv_id -> the contract's values, straight from its words."""
    space = lambda v: " " if v is None else str(v)
    out = {}
    for who in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in (r for r in rows if r[0] == who):
            code = zlib.crc32(f"{space(c)}:{space(turn)}".encode()) % 20 if harm else 9
            role, text = space(role), space(text)
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            own += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        plain, turns = [r[1:] for r in own], [r[0] for r in own if r[0] is not None]
        kinds, (cost, audit) = faults_of(plain), cheapest(plain)
        kept = [f"{r}:{t}" for e, r, t in turns_of(audit, plain) if e != "D"]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        out[who] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def made(seed, n, roles=("user", "assistant", "system", None, "", "tool"), texts=("Yes.", "No!", "", " \n", "cut", None, "why?", "ok. ")):
    rng = random.Random(seed)
    return [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(n) for _ in range(rng.randrange(1, 5))]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("longest", [512, 2])
def test_by_brute_force(spark, longest):
    rows = made(1, 60) + [(None, 0, "user", "Hm."), (None, 1, "assistant", "So."), (900, None, None, None)]
    got = {r[0]: tuple(r)[1:] for r in repair(damaged(spark.createDataFrame(rows, SCHEMA)), longest=longest).collect()}
    want = by_brute_force(rows)
    assert got == want, [(k, got.get(k), v) for k, v in want.items() if got.get(k) != v][:3]


def test_without_damage(spark):
    rows = made(2, 40, roles=("user", "assistant", "system"), texts=("Yes.", "No!", "cut", "why?", "a.", "b.", "c."))
    got = {r[0]: tuple(r)[1:] for r in repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == by_brute_force(rows, harm=False)


def test_steps_know_the_grammar():
    assert steps("s", "fine")[0, 1] == (0, "K") and steps("a", "fine")[0, 3] == (5, "IK") and steps("u", "gone") .keys() >= {(0, 0), (3, 3)}
    assert all("K" not in e for c, e in steps("-", "fine").values()) and steps("u", "cut")[0, 2] == (5, "K")


def test_a_very_long_conversation_is_cut_in_blocks(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"Turn {t % 900}{rng.choice('.!,')}") for t in range(3000)] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Ho.")]
    df = damaged(spark.createDataFrame(rows, SCHEMA))
    one, many = ({r["conv_id"]: r for r in repair(df, longest=n).collect()} for n in (100_000, 64))
    assert one == many and len(one[7]["audit"]) > 2500
    turns = repaired_turns(df, longest=64).where("conv_id = 7").orderBy("place").collect()
    assert "".join(r["edit"] for r in turns) == one[7]["audit"] and [r["place"] for r in turns] == list(range(len(turns)))
    text = "\n".join(f"{r['role']}:{r['text']}" for r in turns if r["edit"] != "D")
    assert hashlib.sha256(text.encode()).hexdigest() == one[7]["repaired_sha256"]
    assert LEGAL.fullmatch("".join(r["role"][0] for r in turns if r["edit"] != "D"))


def test_edge_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(damaged(empty)).count() == 0 and repaired_turns(empty).count() == 0
    wide = spark.createDataFrame([("c", 0, "user", "x" * 200_000 + ".", 1, "fine")], "conv_id string, turn int, role string, text string, place int, kind string")
    row = repair(wide).first()
    assert (row["conv_id"], row["cost"], row["audit"]) == ("c", 2, "D")
    none = by_brute_force([(c, t, "user", "Yes.") for c in range(400) for t in [c]])
    gone = {r["conv_id"]: tuple(r)[1:] for r in repair(damaged(spark.createDataFrame([(c, c, "user", "Yes.") for c in range(400)], SCHEMA))).collect()}
    assert gone == none and (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in gone.values()
