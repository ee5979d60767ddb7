import hashlib

import numpy as np

from gleanery.llm.centroids import LIMIT, delta_lloyd, integers, reassigned, squared


def by_brute_force(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(float(x) * 64)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda r: hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (name(r), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in set(own):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [near(v) for _, v in kept]
    load = {j: sum(d for d, o in last if o == j) for j in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, load[j], sum(load.values()), sha[j]) for (i, _), (d, j) in zip(kept, last)), key=str)


def test_reassigned_is_a_full_comparison():
    rng = np.random.default_rng(0)
    v, old = rng.integers(-3, 4, (400, 5)), rng.integers(-3, 4, (7, 5))
    d = squared(v, old)
    new, moved = old.copy(), np.array([True, False, True, False, False, True, False])
    new[moved] += rng.integers(-1, 2, (3, 5))
    owner, distance = reassigned(v, d.argmin(1), d.min(1), new, moved)
    full = squared(v, new)
    assert (owner == full.argmin(1)).all() and (distance == full.min(1)).all()
    owner, distance = reassigned(v, d.argmin(1), d.min(1), old, np.zeros(7, bool))
    assert (owner == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_integers_round_down_and_stay_bounded():
    assert integers(np.array([-0.01, 0.0, 1 / 64, 3e38, -3e38]), 64).tolist() == [-1, 0, 1, LIMIT, -LIMIT]
    assert squared(np.full((1, 64), LIMIT), np.full((1, 64), -LIMIT))[0, 0] == 64 * (2 * LIMIT) ** 2


def test_by_brute_force_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 64) / 64]) for i in range(120)]
    rows += [(i, rows[i][1]) for i in range(20)]  # repeated rows
    rows += [(200, None), (201, [1.0] * 63), (202, [float("nan")] + [0.0] * 63), (203, [None] + [0.0] * 63), (204, [float("inf")] + [0.0] * 63), (None, [0.5] * 64), (205, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int")
    assert sorted(map(tuple, delta_lloyd(df).collect()), key=str) == by_brute_force(rows)


def test_few_and_no_vectors(spark):
    rows = [(i, [i / 8] * 64) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, delta_lloyd(df).collect()), key=str) == by_brute_force(rows)
    assert delta_lloyd(df.limit(0)).count() == 0
    assert delta_lloyd(df.selectExpr("cast(vec_id AS string) AS vec_id", "embedding")).schema["vec_id"].dataType.simpleString() == "string"
