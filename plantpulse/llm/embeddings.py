"""Near-duplicate embeddings by iterative quantisation and multi-index tables.

Equal vectors of a label collapse to one weighted row. A rotation is learned on
a bounded sample (``SAMPLE`` rows by id hash) so that the signs of the rotated,
centred vectors are balanced binary codes that lose little distance; further
rotations start from other random ones. The codes are cut into substrings, one
hash table each; vectors that agree in a substring meet in its bucket, and each
pair is compared there by the cosine of the original vectors in double
precision, in the first table only where it meets.

The substring length follows the size of the largest label (log2, the usual
choice for multi-index tables), and the number of tables follows from it: a
pair exactly at the threshold must meet somewhere with ``RECALL``. Its angle is
measured on the sample after centring, which widens it where the vectors have a
common direction, and the widest tenth of the angles counts; where that asks for
many more tables, the length of least work is taken, down to one bucket. A
bucket with more than ``CHUNK`` rows is cut into chunks by id hash and every
pair of chunks is a unit of its own, so no bucket sits in one task. No pairs
are emitted: a unit returns link counts and, per vector, the smallest vector it
is connected to inside the unit.

Defined cases: a NULL label, a NULL or empty vector, NULL or non-finite
components, or zero length: no links, own component. Vectors of different
lengths are not compared. Rows with the same id are one vertex; rows with a
NULL id count as copies of their equals and take their component. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, llm_query, scratch, shuffle_parts, table
from .graph import components

SAMPLE, ITERATIONS, RECALL, CHUNK = 10_000, 30, 0.999, 2048
#: Work of one copy of a vector in a table, in comparisons.
COPY = 200


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that tiny and huge ones survive."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Learned rotations; ``tables`` substrings of ``bits`` signs each."""

    def __init__(self, sample: np.ndarray, bits: int, tables: int, seed: int = 7):
        self.dim = sample.shape[1] if sample.ndim == 2 and sample.size else 1
        x = unit(sample) if sample.size else np.zeros((1, 1))
        self.mean = x.mean(axis=0)
        _, axes = np.linalg.eigh(np.cov((x - self.mean).T).reshape(self.dim, self.dim) if len(x) > 1 else np.eye(self.dim))
        self.bits, self.tables = min(bits, self.dim), tables
        self.per = max(1, self.dim // max(1, self.bits))
        rng, v = np.random.default_rng(seed), (x - self.mean) @ axes
        self.turns = []
        for _ in range(-(-tables // self.per)):
            turn = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0]
            for _ in range(ITERATIONS):
                left, _, right = np.linalg.svd(v.T @ np.where(v @ turn >= 0, 1.0, -1.0))
                turn = left @ right
            self.turns.append(axes @ turn[:, rng.permutation(self.dim)])

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) substring values of unit vectors."""
        wide = np.zeros((len(x), self.dim))
        wide[:, :min(self.dim, x.shape[1])] = x[:, :self.dim]
        weight = 1 << np.arange(self.bits, dtype=np.int64)
        out = np.empty((len(x), self.tables), np.int64)
        for r, turn in enumerate(self.turns):
            signs = (wide - self.mean) @ turn >= 0
            for p in range(self.per):
                t = r * self.per + p
                if t < self.tables:
                    out[:, t] = signs[:, p * self.bits:(p + 1) * self.bits] @ weight
        return out


def centred_angles(sample: np.ndarray, threshold: float, seed: int = 11) -> np.ndarray:
    """Angles, seen from the sample's mean, of pairs exactly at the threshold:
    each vector of the sample with partners towards another one of the sample,
    away from it, and in a direction at random."""
    x, rng = unit(sample), np.random.default_rng(seed)
    mean, out = x.mean(axis=0), []
    for side in (x[rng.permutation(len(x))], None, rng.normal(size=x.shape)):
        side = -prior if side is None else side - (side * x).sum(axis=1, keepdims=True) * x
        prior, length = side, np.linalg.norm(side, axis=1, keepdims=True)
        y = threshold * x + math.sqrt(1 - threshold ** 2) * side / np.maximum(length, 1e-300)
        p, q = x - mean, y - mean
        size = np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1)
        ok = (length[:, 0] > 1e-9) & (size > 0)
        out.append(np.arccos(np.clip((p * q).sum(axis=1)[ok] / size[ok], -1, 1)))
    return np.concatenate(out)


def tables_for(bits: int, angles: np.ndarray, recall: float) -> float:
    """Tables of that many bits, so that the widest tenth of the angles meets
    with the recall on average."""
    wide = np.sort(angles)[-max(1, len(angles) // 10):]
    apart = 1 - (1 - wide / math.pi) ** bits
    lo, hi = 0, 1
    while (apart ** hi).mean() > 1 - recall:
        lo, hi = hi, 2 * hi
        if hi > 1 << 16:
            return math.inf
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if (apart ** mid).mean() > 1 - recall else (lo, mid)
    return hi


def plan_tables(largest: int, dim: int, threshold: float, recall: float = RECALL,
                angles: np.ndarray | None = None) -> tuple[int, int]:
    """Substring bits for a label of that many rows, and tables for the recall
    at the given angles of threshold pairs (that of raw vectors by default)."""
    bits = max(4, min(dim, math.ceil(math.log2(max(2, largest)) - 3)))
    raw = np.array([math.acos(threshold)])
    plain = tables_for(bits, raw, recall)
    if angles is None or not len(angles):
        return bits, plain
    tables = {b: tables_for(b, angles, recall) for b in range(min(bits, dim) + 1)}
    if tables[min(bits, dim)] > 2 * plain:
        bits = min(tables, key=lambda b: tables[b] * (COPY + largest / 2 ** b))
    return min(bits, dim), tables[min(bits, dim)]


def unit_links(ids, weights, x, subs, chunk, t: int, threshold: float, crossing: bool):
    """Per row of one unit: weight of rows linked to it, smallest id connected.
    ``crossing``: only pairs of different chunks belong to this unit."""
    n = len(ids)
    links, root = np.zeros(n, np.int64), ids.copy()
    pairs = []
    for lo in range(0, n, 512):
        near = x[lo:lo + 512] @ x.T >= threshold
        near[np.arange(len(near)), lo + np.arange(len(near))] = False
        if crossing:
            near &= chunk[lo:lo + 512, None] != chunk[None, :]
        i, j = np.nonzero(near)
        i += lo
        for earlier in range(t):
            other = subs[i, earlier] != subs[j, earlier]
            i, j = i[other], j[other]
            if not len(i):
                break
        np.add.at(links, i, weights[j])
        pairs.append((i, j))
    moved = True
    while moved:
        moved = False
        for i, j in pairs:
            before = root.copy()
            np.minimum.at(root, i, root[j])
            moved |= bool((before != root).any())
    return links, root


def near_embeddings(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept)."""
    spark = vectors.sparkSession
    v = F.col(vec_col)
    good = (F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
            & F.exists(v, lambda c: c != 0))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          v.cast("array<double>").alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    key = ["k1", "k2"]
    rows = rows.select("*", *[F.when(F.col("good"), F.xxhash64(F.lit(s), "label", "v")).alias(k) for s, k in enumerate(key)])
    reps = scratch(rows.where("good").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"),
                                                        F.first("label").alias("label"), F.first("v").alias("v")), "vectors")
    usable = reps.where("rep is not null")
    # a sample bounded by SAMPLE rows, and one row for the largest label
    sample = [r["v"] for r in usable.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").collect()]
    dim = max((len(s) for s in sample), default=1)
    largest = usable.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    padded = np.array([s + [0.0] * (dim - len(s)) for s in sample])
    angles = centred_angles(padded, threshold) if len(padded) else None
    bits, tables = plan_tables(largest, dim, threshold, angles=angles)
    codes = spark.sparkContext.broadcast(Codes(padded, bits, tables))

    def vector(raw: bytes, size: int) -> np.ndarray:
        return np.frombuffer(raw, np.float32 if len(raw) == 4 * size else np.float64).astype(np.float64)

    def codes_of(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors, padded to one length, and their substrings."""
        width = max(len(v) for v in vectors)
        x = unit(np.stack([np.pad(v, (0, width - len(v))) for v in vectors]))
        return x, codes.value.substrings(x)

    def spread(batches):
        for b in batches:
            if not b.num_rows:
                continue
            vectors = [np.array(v) for v in b.column("v").to_pylist()]
            # single precision where it holds the vector exactly: half the shuffle
            raw = [v.astype(np.float32).tobytes() if (v.astype(np.float32) == v).all() else v.tobytes() for v in vectors]
            subs = codes_of(vectors)[1]
            n, m = subs.shape
            take = pa.array(np.repeat(np.arange(n), m))
            yield pa.RecordBatch.from_arrays(
                [b.column("label").take(take), pa.array([len(v) for v in vectors], pa.int32()).take(take),
                 pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(subs.ravel()),
                 b.column("rep").take(take), b.column("w").take(take), pa.array(raw, pa.binary()).take(take)],
                names=["label", "size", "t", "sub", "rep", "w", "x"])

    at = ["label", "size", "t", "sub"]
    placed = arrow_map(usable.select("label", "rep", "w", "v"), spread,
                       "label string, size int, t int, sub long, rep long, w long, x binary")
    crowded = (placed.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
               .select(*at, F.ceil(F.col("n") / CHUNK).cast("int").alias("g")))
    g = F.coalesce("g", F.lit(1))
    units = (placed.join(crowded, at, "left")
             .withColumn("chunk", F.pmod(F.xxhash64("rep"), g).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), g - 1)))
             .withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("g", "other"))
    place = [*at, "lo", "hi"]
    dealt = units.repartition(shuffle_parts(spark), *place).sortWithinPartitions(*place, "rep")

    def compare(batches):
        open_, held = None, []

        def close():
            if len(held) < 2:
                return None
            ids, w = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
            x, subs = codes_of([vector(h[2], open_[1]) for h in held])
            links, root = unit_links(ids, w, x, subs, np.array([h[3] for h in held]), open_[2], threshold, open_[4] != open_[5])
            some = links > 0
            return (ids[some], links[some], root[some]) if some.any() else None
        for b in batches:
            done = []
            for row in zip(*(b.column(c).to_pylist() for c in (*place, "rep", "w", "x", "chunk"))):
                if row[:6] != open_:
                    done.append(close())
                    open_, held = row[:6], []
                held.append(row[6:])
            done = [d for d in done if d is not None]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*done)], names=["rep", "links", "root"])
        last = close()
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names=["rep", "links", "root"])

    found = scratch(arrow_map(dealt, compare, "rep long, links long, root long"), "embedding-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = (reps.select(*key, "rep", "w").join(counts, "rep", "left")
             .join(comp.select(F.col("vertex").alias("rep"), "component"), "rep", "left"))
    known = known.select(*key, (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"),
                         F.coalesce("component", "rep").alias("component"))
    component = F.coalesce("component", "vec_id")
    return (rows.select("vec_id", *key).join(known, key, "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                    F.col("vec_id").eqNullSafe(component).alias("kept")))


SQL = """
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  WITH RECURSIVE r(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN links l ON l.a = r.other)
  SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN reach USING (vec_id) LEFT JOIN n USING (vec_id)
"""


@llm_query("op6_itq_embeddings", SQL)
def op6_itq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked inside their label at cosine 0.93."""
    return near_embeddings(table(spark, sf_dir, "embeddings"), 0.93)
