"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed once per whole text in Arrow batches by numpy passes
over the UTF-8 bytes (one table lookup, then per-document sums), plus exact
distinct-word and distinct-line ratios. The trees are fitted on a bounded
sample of labelled documents (``max_train_rows``, chosen by the hash of the
id), with quantile-binned features; every tree is then flattened into
(feature, threshold, left, value) arrays and whole batches walk all trees level
by level.

Defined cases: NULL and empty texts have all-zero statistics and are scored
like any other; repeated ids are scored once per row and learned from once (the
row with the smallest statistics, the smallest label); label rows with NULL
quality or id are not used; with no usable label, or labels of one class
only, every score is the smoothed label share (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, held_out, llm_query, scratch, table, texts

FEATURES = ["log_bytes", "log_words", "log_lines", "word_bytes", "upper", "lower", "digit", "space", "newline",
            "stop", "exclaim", "symbol", "other_punct", "non_ascii", "distinct_words", "repeat_next",
            "top_word", "distinct_lines", "symbol_words", "upper_words", "line_bytes"]

#: Most labelled ids used for one fit; more are thinned by the hash of the id.
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3

_UPPER, _LOWER, _DIGIT, _SPACE, _NEWLINE, _STOP, _EXCLAIM, _SYMBOL, _PUNCT, _HIGH = range(10)


def _byte_classes() -> np.ndarray:
    cls = np.full(256, _PUNCT, np.uint8)
    cls[128:] = _HIGH
    for chars, c in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"abcdefghijklmnopqrstuvwxyz", _LOWER),
                     (b"0123456789", _DIGIT), (b" \t\r\x0b\x0c", _SPACE), (b"\n", _NEWLINE), (b".,;:?", _STOP),
                     (b"!", _EXCLAIM), (b"#$%&*+<=>@[]^_`{|}~\\/", _SYMBOL)):
        cls[list(chars)] = c
    return cls


CLASSES = _byte_classes()


def _word_stats(raw: bytes) -> tuple[float, float, float, float, float, float, float]:
    words = raw.split()
    n = len(words)
    lines = raw.split(b"\n")
    if not n:
        return 0.0, 0.0, 0.0, 0.0, float(len(lines) if raw else 0), 0.0, 0.0
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeat = sum(map(bytes.__eq__, words, words[1:])) / n
    symbols = sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?")
    shouted = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    return (len(counts) / n, repeat, max(counts.values()) / n, len(set(lines)) / len(lines), float(len(lines)),
            symbols / n, shouted / n)


def batch_features(column: pa.Array) -> np.ndarray:
    """Statistics of a text column, one row each (NULL as empty)."""
    raw = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    n = len(raw)
    out = np.zeros((n, len(FEATURES)), np.float64)
    if not n:
        return out
    size = np.array([len(x) for x in raw], np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    joined = np.frombuffer(b"".join(raw), np.uint8)
    cls = CLASSES[joined]
    counts = np.zeros((n, 10), np.float64)
    for c in range(10):
        upto = np.concatenate(([0], np.cumsum(cls == c, dtype=np.int64)))
        counts[:, c] = upto[ends] - upto[starts]
    stats = np.array([_word_stats(x) for x in raw]).reshape(n, 7)
    blank = (cls == _SPACE) | (cls == _NEWLINE)
    begins = ~blank
    begins[1:] &= blank[:-1]
    if len(joined):
        first = starts[size > 0]
        begins[first] = ~blank[first]
    upto = np.concatenate(([0], np.cumsum(begins, dtype=np.int64)))
    words = (upto[ends] - upto[starts]).astype(np.float64)
    some, wsome = np.maximum(size, 1), np.maximum(words, 1)
    share = counts / some[:, None]
    solid = size - counts[:, _SPACE] - counts[:, _NEWLINE]
    for i, v in enumerate((np.log1p(size), np.log1p(words), np.log1p(stats[:, 4]), solid / wsome, share[:, _UPPER],
                           share[:, _LOWER], share[:, _DIGIT], share[:, _SPACE], share[:, _NEWLINE], share[:, _STOP],
                           share[:, _EXCLAIM], share[:, _SYMBOL], share[:, _PUNCT], share[:, _HIGH], stats[:, 0],
                           stats[:, 1], stats[:, 2], stats[:, 3], stats[:, 5], stats[:, 6],
                           size / np.maximum(stats[:, 4], 1))):
        out[:, i] = v
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, f: array<double>) of (doc_id, text)."""
    def run(batches):
        for b in batches:
            f = batch_features(b.column("text"))
            flat = pa.array(f.ravel())
            off = pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(off, flat)],
                                             names=["doc_id", "f"])
    return arrow_map(docs, run, "doc_id long, f array<double>")


@dataclass
class FlatTrees:
    """All trees of a model in flat arrays: node i of a tree tests
    ``x[feature[i]] <= threshold[i]`` and goes to ``left[i]`` or ``left[i] + 1``;
    a leaf points to itself. ``roots`` are the trees' first nodes."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    leaf: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(self.roots) or not len(x):
            return out
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[row, self.feature[at]] > self.threshold[at]
            at = np.where(self.leaf[at], at, self.left[at] + right)
        return out + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15,
              bins: int = 64, l2: float = 2.0, min_rows: int = 8) -> FlatTrees:
    """Logistic boosting on quantile histograms; splits maximise the usual
    second-order gain, first feature and lowest bin at ties."""
    n = len(y)
    share = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, leaf, value, roots = [], [], [], [], [], []
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        cell = binned + np.arange(x.shape[1]) * bins
        margin = np.full(n, base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
            roots.append(len(feature))
            level = [(np.arange(n), len(feature))]
            for col, v in ((feature, 0), (threshold, 0.0), (left, 0), (leaf, True), (value, 0.0)):
                col.append(v)
            for d in range(depth + 1):
                after = []
                for rows, node in level:
                    g, h = grad[rows], hess[rows]
                    value[node] = float(-rate * g.sum() / (h.sum() + l2))
                    margin[rows] = margin[rows] + value[node] if d == depth else margin[rows]
                    if d == depth:
                        continue
                    flat = cell[rows].ravel()
                    total = x.shape[1] * bins
                    by = [np.bincount(flat, np.repeat(v, x.shape[1]), total).reshape(-1, bins).cumsum(axis=1)
                          for v in (g, h, np.ones(len(rows)))]
                    gl, hl, cl = by
                    gr, hr, cr = gl[:, -1:] - gl, hl[:, -1:] - hl, cl[:, -1:] - cl
                    gain = gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2)
                    gain[(cl < min_rows) | (cr < min_rows)] = -1.0
                    j, b = divmod(int(gain.argmax()), bins)
                    if gain[j, b] <= 1e-6 or b >= len(cuts[j]):
                        margin[rows] += value[node]
                        continue
                    goes = binned[rows, j] <= b
                    feature[node], threshold[node], left[node], leaf[node] = j, float(cuts[j][b]), len(feature), False
                    for part in (rows[goes], rows[~goes]):
                        after.append((part, len(feature)))
                        for col, v in ((feature, 0), (threshold, 0.0), (left, 0), (leaf, True), (value, 0.0)):
                            col.append(v)
                level = after
    node_value = np.where(np.array(leaf, bool), np.array(value, float), 0.0)
    return FlatTrees(base, depth, np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold, float),
                     np.array(left, np.int64), np.array(leaf, bool), node_value)


def training_sample(labels: DataFrame, usable, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(label_id, y): at most ``max_train_rows`` labelled ids, smallest hash of
    the id first (ties by id); an id labelled more than once takes its smallest
    label."""
    return (labels.where(usable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(F.col("quality").cast("double")).alias("y"))
            .orderBy(F.xxhash64("label_id"), "label_id").limit(max_train_rows))


def train(stats: DataFrame, labels: DataFrame, usable, max_train_rows: int = MAX_TRAIN_ROWS) -> FlatTrees:
    """Fit on the training sample's documents, one row an id: of rows that repeat
    an id the one with the smallest statistics."""
    sample = training_sample(labels, usable, max_train_rows)
    # the sample holds max_train_rows rows of two numbers at most, and so does what is fetched
    got = (stats.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
           .groupBy("doc_id", "y").agg(F.min("f").alias("f")).toArrow())
    order = np.argsort(got.column("doc_id").to_numpy())
    x = got.column("f").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit_trees(x[order], got.column("y").to_numpy()[order])


def score(stats: DataFrame, model: FlatTrees) -> DataFrame:
    """(doc_id, score) of document statistics; the model is a few thousand
    numbers (rounds x 2**(depth+1) nodes)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = b.column("f").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(x))],
                                             names=["doc_id", "score"])
    return arrow_map(stats, run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, usable, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, score) of every document. The statistics are written once to
    the shared folder: texts are read once, fit and scoring read the table."""
    stats = scratch(document_statistics(texts(docs)), "doc-stats")
    return score(stats, train(stats, labels, usable, max_train_rows))


def keep_good(docs: DataFrame, labels: DataFrame, usable, threshold: float = THRESHOLD,
              max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Rows of ``docs`` scored at least ``threshold``, all columns as they are.
    Statistics are written for the labelled sample only (a broadcast of at most
    ``max_train_rows`` ids); one pass over the texts scores and filters."""
    sample = training_sample(labels, usable, max_train_rows)
    own = texts(docs).join(F.broadcast(sample.select("label_id").distinct()), F.col("doc_id") == F.col("label_id"), "left_semi")
    stats = scratch(document_statistics(own), "sample-stats")
    shared = docs.sparkSession.sparkContext.broadcast(train(stats, labels, usable, max_train_rows))

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(shared.value.score(batch_features(b.column("text"))) >= threshold))
    return arrow_map(docs, run, docs.schema)


@llm_query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out quality scores of all documents; learned from the folds whose
    crc32(doc_id) mod 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_scores(docs, labels, ~held_out("doc_id", 5, 0))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
