import math

import numpy as np
import pytest

from plantpulse.llm import embeddings as emb
from plantpulse.llm.common import table


def brute(rows, threshold):
    """id -> (links, smallest reachable) over all pairs of a label."""
    usable = {}
    for i, v, label in rows:
        if label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            usable[i] = (label, np.array(v, float) / np.linalg.norm(np.array(v, float)))
    links = {i: set() for i, _, _ in rows}
    for a, (la, va) in usable.items():
        for b, (lb, vb) in usable.items():
            if a != b and la == lb and len(va) == len(vb) and va @ vb >= threshold:
                links[a].add(b)
    out = {}
    for i in sorted(links):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def planted(n=1500, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind = i % 5
        if kind < 2 or not rows:
            v = rng.normal(size=dim)
        else:  # near an earlier vector, at all angles around the threshold
            near = np.array(rows[int(rng.integers(len(rows)))][1])
            angle = rng.uniform(0, 0.5)
            side = rng.normal(size=dim)
            side -= side @ near / (near @ near) * near
            v = near / np.linalg.norm(near) * math.cos(angle) + side / np.linalg.norm(side) * math.sin(angle)
        rows.append((i, [float(x) for x in v], int(rng.integers(3))))
    hot = rows[7][1]
    rows += [(n + i, [x * (1 + i % 2) for x in hot], rows[7][2]) for i in range(300)]
    return rows


@pytest.mark.parametrize("chunk", [50, 2048])
def test_links_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(emb, "CHUNK", chunk)  # small chunks cut the hot bucket
    rows = planted()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in emb.near_embeddings(df, 0.93).collect()}
    want = brute(rows, 0.93)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert found >= 0.995 * there
    assert sum(got[i][1] != want[i][1] for i in want) <= 0.01 * len(want)


def test_links_of_vectors_with_a_common_direction(spark):
    """Centring widens the angles; recall against all pairs of every 20th id."""
    rng = np.random.default_rng(3)

    def length_one(v):
        return v / np.linalg.norm(v)
    common, rows = length_one(rng.normal(size=64)), []
    for i in range(3000):
        own = rng.normal(size=64)
        own = length_one(own - own @ common * common)
        if i % 2:
            side = rng.normal(size=64)
            side = length_one(side - side @ common * common - side @ last * last)
            angle = rng.uniform(0.6, 0.88)
            own = last * math.cos(angle) + side * math.sin(angle)
        last = own
        rows.append((i, 0.9 * common + math.sqrt(0.19) * own))
    x = np.array([length_one(v) for _, v in rows])
    want = {i: int((x @ x[i] >= 0.93).sum()) - 1 for i in range(0, 3000, 20)}
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in emb.near_embeddings(df, 0.93).collect()}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(want.values()) > 100 and sum(got[i] for i in want) >= 0.995 * sum(want.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
            (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [-1.0, 0.0], 1),
            (13, [1e-200, 0.0], 1), (14, [1.0, 0.0], 2), (None, [1.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, label int, rep int, sub int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in emb.near_embeddings(df, 0.93).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[13] == (2, 1, False)
    assert got[3] == (2, 3, True) and got[14] == (2, 3, False) and got[None] == (2, 3, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert emb.near_embeddings(df.limit(0), 0.93).count() == 0


def test_codes_are_balanced(spark):
    from tests.conftest import SF_MID

    x = np.array([r.embedding for r in table(spark, SF_MID, "embeddings").collect()], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = emb.Codes(x, 8, 8)
    bits = (codes.substrings(x)[:, :, None] >> np.arange(8)) & 1
    assert abs(bits.mean(axis=0) - 0.5).max() < 0.15
