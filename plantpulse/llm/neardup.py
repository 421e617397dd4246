"""Near-duplicate documents by an LSH forest over word-shingle sets.

Documents with equal sets collapse to one representative before anything is
compared. A representative's MinHash values are dealt to several trees; each
tree is one sorted order of the values (range-partitioned, so a region as dense
as it may be is cut at deeper values), and documents with the longest common
prefix stand next to each other. Candidates of a tree are

* all pairs of a small region (equal first value),
* in a larger region the neighbours in sorted order, and every member with the
  region's hub, the member nearest to the region's most common values.

Candidates whose whole signatures agree too little are set aside; the others
are confirmed on the full sets. The orders of the larger regions are walked
again, now pairing only neighbours of different components. What is left of the
larger regions is decided one value deeper: members that also share the second
value and are still in different components meet in units of bounded size,
where all their signatures are compared. Members with a pair that can reach the
similarity (counted in the first tree that both meet in) come again with their
full sets, and those pairs are decided inside the unit, likeliest first; only
links that join components leave it, so a dense region never sends out its
pairs.

Defined cases: NULL and empty texts have empty sets and are linked with
nothing; documents with equal sets of one element or more are linked; rows with
the same id are one vertex; rows with NULL ids take the component of their
equals; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, llm_query, mix64, release, scratch, shuffle_parts, table, texts
from .graph import components
from .shingles import shingle_sets

TREES, DEPTH = 12, 8
#: Regions up to this size are paired completely; above, that many neighbours.
SMALL, NEAR = 8, 2
#: Rows of one region looked at together, and signatures compared at once.
CHUNK, BLOCK = 4096, 1 << 18
#: Rows, and bytes of full sets, in one part of a dense region.
UNIT_ROWS, UNIT_BYTES = 1024, 24 << 20
#: Confirmed are candidates whose signatures agree in at least the asked
#: similarity less five standard deviations of the estimate.
DEVIATIONS = 5.0
#: Walks over the orders before what is left is compared in units.
WALKS = 2
#: Bits of the filter that keeps unconcerned texts out of a shuffle: for each
#: id, and at most (16 MB).
BITS_PER_ID, FILTER_BITS = 16, 1 << 27


class Signature:
    def __init__(self, values: int):
        draw = mix64(np.arange(1, values + 1, dtype=np.uint64))
        self.odd = ((draw >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]

    def __call__(self, shingles: np.ndarray) -> bytes:
        """Minima under every order, as big-endian bytes (they sort as bytes)."""
        key = (shingles >> np.uint64(32)).astype(np.uint32)
        best = None
        for lo in range(0, len(key), 8192):
            least = (key[None, lo:lo + 8192] * self.odd).min(axis=1)
            best = least if best is None else np.minimum(best, least)
        return best.astype(">u4").tobytes()


def sketches(docs: DataFrame, width: int, values: int = TREES * DEPTH) -> DataFrame:
    """(doc_id, n, k1, k2, sig): set size, two set hashes, MinHash values."""
    def run(batches):
        sign = Signature(values)
        for b in batches:
            sets = shingle_sets(b.column("text"), width)
            k1 = [int(np.add.reduce(s)) - (1 << 63) if len(s) else 0 for s in sets]
            k2 = [int(np.add.reduce(mix64(s))) - (1 << 63) if len(s) else 0 for s in sets]
            sig = [sign(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()),
                 pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "k1", "k2", "sig"])
    return arrow_map(docs, run, "doc_id long, n long, k1 long, k2 long, sig binary")


def region_pairs(ids: np.ndarray, comps: np.ndarray, labels: np.ndarray, near: int = NEAR,
                 small: int = SMALL) -> set[tuple[int, int]]:
    """Candidates of one region in sorted order, between components only."""
    n, out = len(ids), set()

    def add(i, j):
        if comps[i] != comps[j]:
            out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    if n <= small:
        for i in range(n):
            for j in range(i):
                add(i, j)
        return out
    for i in range(1, n):
        got, j = 0, i - 1
        while j >= 0 and got < near and i - j <= 64:
            if comps[i] != comps[j]:
                add(i, j)
                got += 1
            j -= 1
    votes = np.zeros(n, np.int64)
    for d in range(1, labels.shape[1]):
        _, at, count = np.unique(labels[:, d], return_inverse=True, return_counts=True)
        votes += count[at]
    names, sizes = np.unique(comps, return_counts=True)
    for c in names[np.argsort(-sizes, kind="stable")[:near]] if len(names) < n else [None]:
        own = np.arange(n) if c is None else np.flatnonzero(comps == c)
        hub = own[votes[own].argmax()]
        for i in range(n):
            add(i, hub)
    return out


def tree_rows(rows: DataFrame, *also: str) -> DataFrame:
    """(tree, label, first, rep, comp) of every tree, from (rep, comp, sig)."""
    return rows.select("rep", "comp", *also, F.explode(F.array(*[
        F.struct(F.lit(t).alias("tree"), F.substring("sig", 1 + 4 * DEPTH * t, 4 * DEPTH).alias("label"))
        for t in range(TREES)])).alias("x")).select("x.tree", "x.label", F.substring("x.label", 1, 4).alias("first"), "rep", "comp", *also)


def larger_regions(rows: DataFrame) -> DataFrame:
    """(tree, first): the regions of more than ``SMALL`` rows."""
    return tree_rows(rows).groupBy("tree", "first").count().where(F.col("count") > SMALL).select("tree", "first")


def tree_candidates(rows: DataFrame, large: DataFrame, again: bool, near: int = NEAR) -> DataFrame:
    """(a, b): distinct candidate pairs of all trees, from (rep, comp, sig); of
    the larger regions only, when walked ``again``. A small region is never cut
    by a border of the ranges, since its rows have one sort key."""
    parts = shuffle_parts(rows.sparkSession)
    trees = tree_rows(rows).join(large.withColumn("large", F.lit(True)), ["tree", "first"], "inner" if again else "left")
    at = [F.col("tree"), F.when(F.col("large"), F.col("label")).otherwise(F.col("first")), F.when(F.col("large"), F.col("rep"))]
    ranged = (trees.repartitionByRange(parts, *at).select("tree", "label", "rep", "comp")
              .sortWithinPartitions("tree", "label", "rep"))

    def run(batches):
        key, held = None, []  # of the region that is open

        def close():
            if len(held) < 2:
                return []
            ids, comps = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
            if comps.min() == comps.max():
                return []
            labels = np.frombuffer(b"".join(h[2] for h in held), ">u4").reshape(len(held), DEPTH)
            return region_pairs(ids, comps, labels, near)
        for b in batches:
            found: set[tuple[int, int]] = set()
            for tree, label, rep, comp in zip(*(b.column(c).to_pylist() for c in ("tree", "label", "rep", "comp"))):
                here = (tree, label[:4])
                if here != key or len(held) >= CHUNK:
                    found.update(close())
                    # a chunk's last rows stay, so that its order goes on
                    held = held[-near:] if here == key else []
                    key = here
                held.append((rep, comp, label))
            if found:
                a, c = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])
        found = close()
        if found:
            a, c = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])
    return arrow_map(ranged, run, "a long, b long").distinct()


def likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in a share of at least ``least``."""
    sig = reps.select(F.col("rep"), "sig")
    both = (pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), ">u4").reshape(b.num_rows, -1) for c in ("sa", "sb"))
                ok = pa.array((x == y).mean(axis=1) >= least)
                yield b.select(["a", "b"]).filter(ok)
    return arrow_map(both, run, "a long, b long")


def with_listed_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) whose id is in ``ids`` (distinct). A Bloom filter,
    sized by their number up to ``FILTER_BITS``, lets nearly all other texts go
    before the exact semi-join shuffles the rest; an overfull filter lets more
    through and changes nothing else."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (max(1, ids.count() * BITS_PER_ID) - 1).bit_length()))
    mask = bits - 1

    def places(h):
        return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 20).bitwiseAND(mask), F.shiftrightunsigned(h, 37).bitwiseAND(mask)]
    spots = ids.select(F.explode(F.array(*places(F.xxhash64("doc_id")))).alias("p"))
    words = (spots.groupBy(F.shiftright("p", 5).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 AS int))")).alias("bits")).toArrow())
    table_ = np.zeros(bits >> 5, np.uint32)  # at most bits / 32 rows came
    table_[words.column("w").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    shared = docs.sparkSession.sparkContext.broadcast(table_)

    def run(batches):
        has = shared.value
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            ok = np.ones(len(h), bool)
            for shift in (0, 20, 37):
                p = (h >> np.uint64(shift) & np.uint64(mask)).astype(np.int64)
                ok &= (has[p >> 5] >> (p & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
            if ok.any():
                yield b.select(["doc_id", "text"]).filter(pa.array(ok))
    passed = arrow_map(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h")), run, "doc_id long, text string")
    return passed.join(ids, "doc_id", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets satisfy 100 |A n B| >= percent |A u B|. The
    sets of the documents in question are computed from their texts again.
    Written, so that those sets can go."""
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def sets(batches):
        for b in batches:
            raw = [s.tobytes() for s in shingle_sets(b.column("text"), width)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], names=["id", "set"])

    own = scratch(arrow_map(with_listed_ids(docs, ends), sets, "id long, set binary"), "sets")
    both = (pairs.join(own.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
            .join(own.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b"))

    def test(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok.append(bool(len(x) and len(y)) and similar(x, y, percent))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    found = scratch(arrow_map(both, test, "a long, b long"), "confirmed")
    release(own)
    return found


def unit_pairs(ids: np.ndarray, comps: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, side: np.ndarray,
               percent: int, least: float, tree: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of rows of different components (and of different sides,
    if there are two) whose sizes and signatures allow the similarity, likeliest
    first; with ``tree``, only pairs that share the first two values of no
    earlier tree. Signatures are compared by one byte of each value first, which
    never agrees less."""
    order = np.lexsort((ids, comps))
    comps, sizes, sigs, side = comps[order], sizes[order], sigs[order], side[order]
    low = np.ascontiguousarray((sigs & 0xFF).astype(np.uint8))
    need, two = least * sigs.shape[1], side.min() != side.max()
    edges = [0, *(np.flatnonzero(np.diff(comps)) + 1).tolist(), len(ids)]
    out = []
    for lo, hi in zip(edges, edges[1:-1]):  # against the components behind it
        block = max(1, BLOCK // max(1, len(ids) - hi))
        for at in range(lo, hi, block):
            end = min(hi, at + block)
            same = (low[at:end, None, :] == low[None, hi:, :]).sum(axis=2)
            x, y = np.nonzero(same >= need)
            x, y = x + at, y + hi
            ok = 100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])
            if two:
                ok &= side[x] != side[y]
            x, y = x[ok], y[ok]
            if len(x):
                agree = sigs[x] == sigs[y]
                ok = agree.sum(axis=1) >= need
                if tree is not None:
                    ok &= agree.reshape(len(x), TREES, DEPTH)[:, :, :2].all(axis=2).argmax(axis=1) == tree
                out.append(np.stack([x[ok], y[ok], agree[ok].sum(axis=1)]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y, agree = np.concatenate(out, axis=1)
    likely_first = np.argsort(-agree, kind="stable")
    return order[x[likely_first]], order[y[likely_first]]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 |x n y| >= percent |x u y| of two sorted sets, neither of them empty."""
    if len(x) > len(y):
        x, y = y, x
    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def joining_links(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], x: np.ndarray, y: np.ndarray,
                  percent: int) -> list[tuple[int, int]]:
    """Of the pairs (x, y), in turn, those links that join two components."""
    up = {c: c for c in comps.tolist()}

    def top(c):
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c
    out = []
    for i, j in zip(x.tolist(), y.tolist()):
        p, q = top(int(comps[i])), top(int(comps[j]))
        if p != q and similar(sets[i], sets[j], percent):
            up[p] = q
            out.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
    return out


UNIT = ["tree", "at", "i", "j"]


def dense_units(rows: DataFrame, large: DataFrame, chunk: int = UNIT_ROWS, set_bytes: int = UNIT_BYTES) -> DataFrame:
    """(tree, at, i, j, side, rep, comp, n, sig): rows of (rep, comp, n, sig)
    that share the first two values of a tree in one of the ``large`` regions
    with another component. A region of more than ``chunk`` rows or
    ``set_bytes`` of sets is cut, and every two of its parts meet in a unit."""
    own = ["tree", "at"]
    at = (tree_rows(rows, "n", "sig").join(large, ["tree", "first"], "left_semi")
          .select("tree", F.substring("label", 1, 8).alias("at"), "rep", "comp", "n", "sig"))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / chunk, F.sum("n") * 8 / set_bytes)).cast("int")
    mixed = (at.groupBy(*own).agg(parts.alias("parts"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .where("lo < hi").select(*own, "parts"))
    at = at.join(mixed, own).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    at = at.select(*own, "rep", "comp", "n", "sig", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    at = at.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other"), "side": (F.col("part") > F.col("other")).cast("int")})
    return at.select(*UNIT, "side", "rep", "comp", "n", "sig")


def _units(batches, names: list[str]):
    """Rows of each unit in turn, from batches sorted by unit."""
    key, held = None, []
    for b in batches:
        keys = zip(*(b.column(c).to_pylist() for c in UNIT))
        for k, row in zip(keys, zip(*(b.column(c).to_pylist() for c in names))):
            if k != key:
                if len(held) > 1:
                    yield key, list(zip(*held))
                key, held = k, []
            held.append(row)
    if len(held) > 1:
        yield key, list(zip(*held))


def _pairs_of(key, ids, comps, sizes, sigs, side, percent: int, least: float):
    ids, comps = np.array(ids, np.int64), np.array(comps, np.int64)
    sigs = np.frombuffer(b"".join(sigs), ">u4").reshape(len(ids), -1).astype(np.uint32)
    return ids, comps, *unit_pairs(ids, comps, np.array(sizes, np.int64), sigs, np.array(side), percent, least, key[0])


def dense_links(units: DataFrame, docs: DataFrame, width: int, percent: int, least: float) -> DataFrame:
    """(a, b): links between the components of ``units``; together with the
    links inside the components they are as good as all links of the units."""
    parts, names = shuffle_parts(docs.sparkSession), ["rep", "comp", "n", "sig", "side"]
    kinds = "tree int, at binary, i int, j int, rep long, comp long, n long, sig binary, side int"

    def dealt(df):
        return df.repartition(parts, *UNIT).sortWithinPartitions(*UNIT)

    def concerned(batches):
        for key, columns in _units(batches, names):
            *_, x, y = _pairs_of(key, *columns, percent, least)
            rows = np.unique(np.concatenate([x, y])).tolist()
            if rows:
                yield pa.RecordBatch.from_pydict(
                    {c: pa.array([v] * len(rows), t) for c, v, t in zip(UNIT, key, (pa.int32(), pa.binary(), pa.int32(), pa.int32()))}
                    | {c: pa.array([columns[k][r] for r in rows], t) for k, (c, t) in enumerate(
                        zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())))})

    def sets(batches):
        for b in batches:
            raw = [s.tobytes() for s in shingle_sets(b.column("text"), width)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], names=["id", "set"])

    def decided(batches):
        for key, columns in _units(batches, [*names, "set"]):
            ids, comps, x, y = _pairs_of(key, *columns[:-1], percent, least)
            found = joining_links(ids, comps, [np.frombuffer(s, np.uint64) for s in columns[-1]], x, y, percent)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    left = scratch(arrow_map(dealt(units).select(*UNIT, *names), concerned, kinds), "concerned")
    ids = left.select(F.col("rep").alias("doc_id")).distinct()
    own = scratch(arrow_map(with_listed_ids(docs, ids), sets, "id long, set binary"), "sets")
    both = dealt(left.join(own.withColumnRenamed("id", "rep"), "rep")).select(*UNIT, *names, "set")
    found = scratch(arrow_map(both, decided, "a long, b long"), "dense-links")
    release(left, own)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text)."""
    sketch = scratch(sketches(docs, width), "sketches")
    key = ["n", "k1", "k2"]
    groups = (sketch.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")))
    reps = scratch(groups, "representatives")
    s = percent / 100
    least = s - DEVIATIONS * (s * (1 - s) / (TREES * DEPTH)) ** 0.5
    links = comp = tried = None
    again = sketch.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    same = (sketch.join(again, "doc_id", "left_semi").join(reps.select(*key, "rep"), key)
            .select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct())
    same = scratch(same, "repeated-ids")
    if not same.isEmpty():
        links, comp = same, components(same)
    usable = reps.where("rep is not null").select("rep", "n", "sig")
    large = scratch(larger_regions(usable.withColumn("comp", F.col("rep"))), "larger-regions")
    for step in range(WALKS + 1):
        rows = usable.withColumn("comp", F.col("rep"))
        if comp is not None:
            rows = (usable.join(comp.select(F.col("vertex").alias("rep"), F.col("component").alias("comp")), "rep", "left")
                    .withColumn("comp", F.coalesce("comp", "rep")))
        if step < WALKS:
            pairs = likely(tree_candidates(rows, large, step > 0), reps, least)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            tried = pairs = scratch(pairs, "candidates")
            new = confirmed(pairs, docs, width, percent)
        else:
            new = dense_links(dense_units(rows, large), docs, width, percent, least)
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            comp = components(links)
    found = sketch.select("doc_id", *key).join(reps.select(*key, "rep"), key, "left")
    if comp is not None:
        found = found.join(comp, F.coalesce("rep", "doc_id") == F.col("vertex"), "left")
    else:
        found = found.withColumn("component", F.lit(None).cast("long"))
    component = F.coalesce("component", "rep", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, all columns as they
    are: the row with the smallest id (NULL last). Decided per row, so a row goes
    only when its own text lost, whatever other rows have its id. Rows without
    words link with nothing and stay; of those that repeat an id and the text,
    one stays."""
    row = "_pp_row"
    numbered = scratch(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # numbers are fixed from here on
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), text.alias("text")), width, percent)
    found = scratch(found.where("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id"), "near-duplicates")
    ident = F.col("doc_id").cast("long")
    first = F.min(F.struct(ident.isNull().alias("none"), ident.alias("id"), F.col(row).alias("row")))["row"].alias(row)
    stay = found.join(numbered.select(row, "doc_id"), row).groupBy("component_id").agg(first).select(row)
    blank = numbered.where(~text.rlike(r"[^\x20\x09-\x0D]") & ident.isNotNull()).select(row, "doc_id", "text")
    stay_blank = blank.groupBy("doc_id", "text").agg(F.min(row).alias(row)).select(row)
    gone = (found.select(row).join(stay, row, "left_anti")
            .unionByName(blank.select(row).join(stay_blank, row, "left_anti")))
    return numbered.join(gone, row, "left_anti").drop(row)


@llm_query("op4_lsh_forest")
def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by 4-word shingles at 80 %."""
    return near_duplicates(texts(table(spark, sf_dir, "documents")), width=4, percent=80)
