import re

import numpy as np
import pyarrow as pa
import pytest

from plantpulse.llm import neardup
from plantpulse.llm.common import texts
from plantpulse.llm.graph import components
from plantpulse.llm.shingles import shingle_sets

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall((text or "").encode().lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, width, percent):
    """id -> (set size, smallest id reachable), over all pairs."""
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t, width))
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            for x in sets[a]:
                for y in sets[b]:
                    same = len(x & y)
                    if same and 100 * same >= percent * len(x | y):
                        p, q = sorted((top(a), top(b)))
                        up[q] = p
    return {d: top(d) for d in ids}


def test_sets_against_brute_force():
    rng = np.random.default_rng(0)
    parts = ["", " ", "a", "A b", "a\tB\nc\r\x0b\x0cD", "é É\xa0x y z", "one two three four five", None]
    parts += [" ".join(rng.choice(["a", "b", "cc", "Dd", "é"], rng.integers(1, 40))) for _ in range(200)]
    for width in (4, 5):
        got = shingle_sets(pa.array(parts), width)
        want = [shingles(t, width) for t in parts]
        assert [len(g) for g in got] == [len(w) for w in want]
        pool = {}
        for g, w in zip(got, want):  # equal sets, equal hashes
            assert pool.setdefault(w, tuple(g.tolist())) == tuple(g.tolist())
        for i in range(0, 200, 7):
            for j in range(0, 200, 11):
                assert len(set(got[i].tolist()) & set(got[j].tolist())) == len(want[i] & want[j])


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    links += [(2000, 2000 + i) for i in range(1, 50)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {v: v for e in links for v in e if e[0] != e[1]}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        if a != b:
            p, q = sorted((top(a), top(b)))
            up[q] = p
    assert got == {v: top(v) for v in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def planted(seed=0):
    """Copies, near copies in stars and chains, shared passages, odd texts."""
    rng = np.random.default_rng(seed)
    vocab = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(4000)]

    def fresh(n):
        return list(rng.choice(vocab, n))

    def edited(words, share):
        out = list(words)
        for i in rng.choice(len(out), max(1, int(len(out) * share)), replace=False):
            out[i] = str(rng.choice(vocab))
        return out
    shared = fresh(60)
    docs = [fresh(rng.integers(1, 120)) for _ in range(60)]
    for _ in range(6):
        base = fresh(150)
        docs += [base, list(base), *[edited(base, s) for s in (0.01, 0.02, 0.03, 0.05, 0.1)]]
    star = fresh(200)
    docs += [star, *[edited(star, 0.018) for _ in range(60)]]  # members near the centre, less near each other
    chain = fresh(120)
    for _ in range(12):
        chain = edited(chain, 0.02)
        docs.append(chain)
    docs += [fresh(40) + shared for _ in range(40)]
    rows = [" ".join(d) for d in docs] + [None, "", "", "one", "one", "a b c", "A  b\nC", "same words here now"] * 2
    order = rng.permutation(len(rows))
    return [(int(i) * 3 + 7, rows[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("width", [4, 5])
def test_components_against_all_pairs(spark, odd_docs, width):
    rows = planted(width)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(texts(df), width, 80).collect()
    want = brute(rows, width, 80)
    assert {r.doc_id: r.component_id for r in got} == want
    by = dict(rows)
    assert all(r.n_shingles == len(shingles(by[r.doc_id], width)) and r.kept == (want[r.doc_id] == r.doc_id) for r in got)


def test_dense_regions_are_linked_whole():
    """Region candidates reach every member also when a region is large."""
    n = 500
    ids, labels = np.arange(n), np.zeros((n, neardup.DEPTH), np.uint32)
    pairs = neardup.region_pairs(ids, ids, labels)
    assert len(pairs) < 4 * n and {p for pair in pairs for p in pair} == set(range(n))
    assert not neardup.region_pairs(ids, np.zeros(n, int), labels)
    split = np.arange(n) % 2
    assert all(split[a] != split[b] for a, b in neardup.region_pairs(ids, split, labels))


def test_unit_pairs_against_all_pairs():
    """Units of one and of two sides, many components, ties of sizes."""
    rng = np.random.default_rng(9)
    n = 300
    sigs = rng.integers(0, 3, (n, 96)).astype(np.uint32) * np.uint32(256)  # the low byte tells nothing
    ids, comps, sizes = rng.permutation(n), rng.integers(0, 40, n), rng.integers(80, 120, n)
    for side in (np.zeros(n, int), rng.integers(0, 2, n)):
        x, y = neardup.unit_pairs(ids, comps, sizes, sigs, side, 80, 0.4)
        a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
        want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(n) for j in range(i)
                if comps[i] != comps[j] and (side[i] != side[j] or not side.any())
                and 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j]) and (sigs[i] == sigs[j]).mean() >= 0.4}
        assert len(want) > 100 and sorted(zip(a.tolist(), b.tolist())) == sorted(want)


def test_cut_regions_meet_in_every_unit(spark):
    """A region of many parts gives the links of a whole one, each pair is
    looked at in one tree, and only joining links leave."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        own = list(words)
        for k in rng.choice(np.arange(100), 6 + i % 9, replace=False):
            own[k] = f"x{i}y{k}"
        rows.append((i, " ".join(own)))
    docs = texts(spark.createDataFrame(rows, "doc_id long, text string"))
    sketch = neardup.sketches(docs, 1).selectExpr("doc_id AS rep", "doc_id % 140 AS comp", "n", "sig")
    large = neardup.larger_regions(sketch)

    def tops(**kw):
        found = neardup.dense_links(neardup.dense_units(sketch, large, **kw), docs, 1, 80, 0.5).collect()
        inside = [(i, i % 140) for i in range(150) if i >= 140]
        got = components(spark.createDataFrame([(r.a, r.b) for r in found] + inside, "a long, b long")).collect()
        return len(found), {r.vertex: r.component for r in got}
    whole, cut = tops(), tops(chunk=17)
    assert whole[1] == cut[1] == tops(set_bytes=20_000)[1] and 10 < whole[0] < 12 * 150
    want = brute([(i, t) for i, t in rows], 1, 80)
    together = {}
    for i in range(150):
        together.setdefault(want[i], set()).add(i)
    assert max(map(len, together.values())) > 20


@pytest.mark.parametrize("bits", [1 << 25, 64])  # roomy, and overfull
def test_filter_keeps_exactly_the_listed(spark, odd_docs, monkeypatch, bits):
    monkeypatch.setattr(neardup, "FILTER_BITS", bits)
    docs = spark.range(500).selectExpr("id - 250 AS doc_id", "cast(id AS string) AS text")
    ids = docs.where("doc_id % 7 = 0").select("doc_id")
    got = {r.doc_id for r in neardup.with_listed_ids(docs, ids).collect()}
    assert got == {i for i in range(-250, 250) if i % 7 == 0}
    assert neardup.with_listed_ids(docs, ids.limit(0)).count() == 0


def test_odd_documents_and_stage(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in neardup.near_duplicates(texts(odd_docs), 5, 80).collect()}
    assert got[11].component_id == 10 and not got[11].kept and got[10].kept
    assert got[0].n_shingles == 0 and got[0].kept and got[1].kept and got[None].component_id is None
    out = neardup.keep_first(odd_docs)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == odd_docs.columns
    assert sorted(ids, key=str) == sorted([*range(11), 12, 13, 14, None], key=str)  # one of 10 and 11, row 3 once
    assert neardup.keep_first(no_docs).count() == 0


def test_undecided_members_of_a_dense_region_are_linked(spark, odd_docs):
    """All texts share most words, so every first value is common; each is near
    one other text only."""
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(70)]
    rows = []
    for p in range(200):
        pair = [f"p{p}x{i}" for i in range(9)]
        for side in "ab":
            rows.append((len(rows), " ".join(common + pair + [f"{side}{p}x{i}" for i in range(8)])))
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(texts(df), 1, 80).collect()}
    assert got == brute(rows, 1, 80) and len(set(got.values())) == 200


def test_rows_of_one_id_are_decided_by_their_own_texts(spark, no_docs):
    """A row goes only when its own text lost; equal ids are one vertex."""
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, base), (5, base), (5, other), (None, None), (None, None), (None, " "), (7, ""), (None, "alone at last here now"),
            (None, "alone at last here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in neardup.keep_first(df).collect()), key=str)
    want = [(1, base), (5, other), (None, None), (None, None), (None, " "), (7, ""), (None, "alone at last here now")]
    assert got == sorted(want, key=str)
    found = neardup.near_duplicates(texts(df.where("doc_id is not null")), 5, 80).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (5, 1), (5, 1), (7, 7)]


def test_query_against_brute_force(spark):
    from plantpulse.llm import QUERIES
    from tests.conftest import SF_SMALL

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r.component_id for r in QUERIES["op4_lsh_forest"](spark, SF_SMALL).collect()}
    assert got == brute(rows, 4, 80)
