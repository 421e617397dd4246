"""Personal data by bootstrapped contextual extraction.

Base recognisers find e-mail addresses, IP addresses, card numbers (Luhn) and
phone numbers. These seeds induce lexical patterns: the two words before, the
word before with the word after, and the word before alone, each together with
the entity's whole shape (digit runs as 9, letter runs as a). Identifier-like
words of any length outside the seeds (with a digit or an @), and whole runs of
neighbouring words of digits and phone or card punctuation, match the same
patterns and make a
bipartite pattern-instance graph, which Spark scores for a fixed number of
rounds: a pattern is as sure as the mean score of its distinct instances, an
instance as sure as its patterns together. Instances above the threshold that
no recogniser knows are added with the kind that scored best.

Defined cases: NULL text is empty and has no spans; offsets count code points,
end exclusive; matches of one kind do not overlap, and a match that fails its
test is dropped without another try; recognisers are linear in the text, also
in long runs of one character; rows are kept apart by a row number, so repeated
ids and repeated rows keep their own spans; other columns pass through. A word
inside a discovered run may be discovered besides it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import llm_query, scratch, table, texts

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring, least distinct seeds behind a pattern, and the score an
#: instance needs to be added.
ROUNDS, MIN_SEEDS, MIN_SCORE = 3, 8, 0.9

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run is tried from its start only: later starts in it fail alike
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKED = re.compile(r"[0-9@]")
WORD = re.compile(r"\S++")
TRIM = "\"'()[]{}<>,.;:!?="
DIGITS = re.compile(r"[0-9]+")
LETTERS = re.compile(r"[^\W\d_]+")
#: Values shorter than this are instances together with the word before.
SHORT = 5
#: A part of an identifier written in groups, and what its ends lose.
PART = re.compile(r"[0-9+(][0-9().+/-]*+")
EDGES = "\"'[]{}<>,;:!?="


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the recognised entities, sorted."""
    found = []
    at, floor = text.find("@"), 0
    while at >= 0:
        local = text[floor:at]
        n = len(local) - len(local.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if n else None
        floor = m.end() if m else at + 1
        if m:
            found.append((at - n, 0, m.end()))
        at = text.find("@", floor)
    if MARKED.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and _luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _signed(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def _shape(value: str) -> str:
    return LETTERS.sub("a", DIGITS.sub("9", value))


def instances(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and identifier-like words of a text with their pattern hashes."""
    if not MARKED.search(text):
        return []
    spans = [m.span() for m in WORD.finditer(text)]
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    out = []

    def word(i: int) -> str:
        return text[spans[i][0]:spans[i][1]].strip(TRIM).lower() if 0 <= i < len(spans) else ""

    def add(start: int, end: int, kind: int) -> None:
        lo, hi = bisect_right(ends, start), bisect_left(starts, end)
        value = text[start:end]
        shape, l1, l2, r1 = _shape(value), word(lo - 1), word(lo - 2), word(hi)
        keys = (f"ll|{l2}|{l1}|{shape}", f"lr|{l1}|{r1}|{shape}", f"l|{l1}|{shape}")
        own = value.lower() if len(value) >= SHORT else f"{l1} {value.lower()}"
        out.append({"start": start, "end": end, "kind": kind, "value": _signed(own),
                    "patterns": [_signed(k) for k in keys]})

    for start, kind, end in base:
        add(start, end, kind)
    covered, last = sorted((s, e) for s, _, e in base), 0
    run: list[tuple[int, int]] = []  # neighbouring parts, over single spaces

    def close() -> None:
        if len(run) > 1:
            start, end = run[0][0], run[-1][1]
            end = start + len(text[start:end].rstrip(".-+(/"))
            opened, closed = text.count("(", start, end), text.count(")", start, end)
            while text[end - 1] == ")" and closed > opened:
                end, closed = end - 1, closed - 1
            if text[start] == "(" and text.find(")", start, end) == end - 1:  # brackets around the whole
                end, closed = end - 1, 0
            if not closed:
                start = end - len(text[start:end].lstrip("("))
            add(start, end, -1)
        run.clear()
    for a, b in spans:
        raw = text[a:b]
        if not MARKED.search(raw):
            close()
            continue
        while last < len(covered) and covered[last][1] <= a:
            last += 1
        if last < len(covered) and covered[last][0] < b:
            close()
            continue
        lead, tail = a + len(raw) - len(raw.lstrip(EDGES)), b - (len(raw) - len(raw.rstrip(EDGES)))
        if run and (lead > a or run[-1][1] + 1 != a or text[a - 1] != " "):
            close()
        if lead < tail and PART.fullmatch(text, lead, tail):
            run.append((lead, tail))
            if tail < b:
                close()
        else:
            close()
        core = raw.strip(TRIM)
        if core:
            start = a + raw.index(core)
            add(start, start + len(core), -1)
    close()
    return out


SPAN = "struct<start:long,kind:int,end:long>"
ITEM = "struct<start:long,end:long,kind:int,value:long,patterns:array<long>>"


def _arrow(name: str) -> pa.DataType:
    if name == "base":
        return pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    return pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()),
                               ("patterns", pa.list_(pa.int64()))]))


def scan(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``base`` spans and graph ``items`` of every whole text."""
    kept = T.StructType([f for f in docs.schema.fields if keep_text or f.name != text_col])
    names = kept.names
    schema = T.StructType([*kept.fields, *T._parse_datatype_string(f"base array<{SPAN}>, items array<{ITEM}>").fields])

    def run(batches):
        for b in batches:
            base = [base_spans(t or "") for t in b.column(text_col).to_pylist()]
            items = [instances(t or "", s) for t, s in zip(b.column(text_col).to_pylist(), base)]
            spans = [[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in base]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(spans, _arrow("base")),
                                              pa.array(items, _arrow("items"))], names=[*names, "base", "items"])
    return docs.mapInArrow(run, schema)


def discover(scanned: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
             min_score: float = MIN_SCORE) -> DataFrame:
    """(value, kind): instances no recogniser knows, sure by their patterns.

    Every table is per distinct pattern or instance and is pre-aggregated by
    Spark before it is shuffled; tables of a round are written to the shared
    folder."""
    edges = (scanned.select(F.explode("items").alias("i"))
             .select(F.col("i.value").alias("value"), F.col("i.kind").alias("kind"), F.explode("i.patterns").alias("pattern"))
             .distinct())
    seeds = (edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("pattern").agg(F.max("n").alias("n")).where(F.col("n") >= min_seeds).select("pattern"))
    edges = scratch(edges.join(seeds, "pattern", "left_semi"), "pii-edges")
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    known = edges.where("kind >= 0").select("pattern", "value", "kind", F.lit(1.0).alias("score"))
    unknown = edges.where("kind < 0").select("pattern", "value")
    scores = None
    for _ in range(rounds):
        now = known
        if scores is not None:
            now = known.unionByName(unknown.join(scores, "value").select("pattern", "value", "kind", "score"))
        sure = (now.groupBy("pattern", "kind").agg(F.sum("score").alias("mass"))
                .join(totals, "pattern")
                .select("pattern", "kind", (F.col("mass") / (F.col("total") + 1)).alias("sure"))
                .where("sure >= 0.5"))
        scores = (unknown.join(sure, "pattern").groupBy("value", "kind")
                  .agg((1 - F.exp(F.sum(F.log(1 - F.col("sure"))))).alias("score")))
        scores = scratch(scores, "pii-scores")
    best = F.max_by("kind", F.struct("score", -F.col("kind")))
    return (scores.groupBy("value").agg(best.alias("kind"), F.max("score").alias("score"))
            .where(F.col("score") >= min_score).select("value", "kind"))


def all_spans(scanned: DataFrame, row: str, found: DataFrame) -> DataFrame:
    """(row, added): the spans of discovered instances, per row that has any."""
    items = (scanned.select(row, F.explode("items").alias("i")).where("i.kind < 0")
             .select(row, F.col("i.start").alias("start"), F.col("i.end").alias("end"), F.col("i.value").alias("value")))
    return (items.join(found, "value")
            .groupBy(row).agg(F.collect_list(F.struct("start", F.col("kind").cast("int").alias("kind"), "end")).alias("added")))


def with_spans(docs: DataFrame, text_col: str = "text", keep_text: bool = True, row: str = "_pii_row") -> DataFrame:
    """``docs`` (text left out unless kept) with ``base`` and ``spans``, both
    sorted arrays of (start, kind, end)."""
    scanned = scan(docs, text_col, keep_text).withColumn(row, F.monotonically_increasing_id())
    scanned = scratch(scanned, "pii-scan")  # row numbers are fixed from here on
    added = all_spans(scanned, row, discover(scanned))
    joined = scanned.drop("items").join(added, row, "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))))
    return joined.withColumn("spans", spans).drop("added", row)


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping
    spans are masked as the first of them, to the end of the last. Texts
    without a digit or an @ have no spans and pass by untouched."""
    columns, text_type = docs.columns, docs.schema[text_col].dataType
    has = F.coalesce(F.col(text_col).rlike("[0-9@]"), F.lit(False))
    text = f"c{columns.index(text_col)}"  # columns go by number, so that no name clashes
    inner = docs.where(has).toDF(*[f"c{i}" for i in range(len(columns))])
    marked = with_spans(inner.withColumn(text, F.col(text).cast("string")), text, True)

    def run(batches):
        for b in batches:
            out = []
            for raw, spans in zip(b.column(text).to_pylist(), b.column("spans").to_pylist()):
                parts, at = [], 0
                for s in spans or []:
                    if s["start"] >= at:
                        parts += [raw[at:s["start"]], f"<{KINDS[s['kind']]}>"]
                    at = max(at, s["end"])
                out.append("".join(parts) + raw[at:] if parts else raw)
            yield b.set_column(b.schema.get_field_index(text), text, pa.array(out, pa.string()))

    done = marked.mapInArrow(run, marked.schema).select(*[f"c{i}" for i in range(len(columns))]).toDF(*columns)
    return done.withColumn(text_col, F.col(text_col).cast(text_type)).unionByName(docs.where(~has))


def span_text(spans):
    """kind:start:end, comma-joined, of a sorted span array."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


@llm_query("op5_pii_bootstrap")
def op5_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: recognised counts and all spans."""
    found = with_spans(texts(table(spark, sf_dir, "documents")), keep_text=False)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}")
              for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))
