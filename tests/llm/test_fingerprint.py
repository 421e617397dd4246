import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.llm import fingerprint as fp
from plantpulse.llm.common import texts


def slow(text, o):
    """Order MinHash without blocks, sorting or doubling."""
    if not text:
        return o.empty
    codes = [ord(c) for c in text]
    k = min(o.k, len(codes))
    kmers = [int(o.kmers(np.array(codes[i:i + k], np.uint32))[0]) for i in range(len(codes) - k + 1)]
    bits = len(kmers).bit_length()
    seen, key = {}, []
    for h in kmers:
        kind = h >> bits << bits
        n = seen.get(kind, 0)
        seen[kind] = n + 1
        key.append((kind, int(fp.mix64(np.array([(kind + n) % 2**64], np.uint64))[0]) >> 32))
    out = []
    for a in o.odd.ravel().tolist():
        # equal hashes: the order of (k-mer, position) decides
        order = sorted(range(len(key)), key=lambda i: (key[i][1] * a % 2**32, key[i][0], i))[:o.l]
        t = 0
        for j, i in enumerate(sorted(order)):
            t = int(fp.mix64(np.array([(t * 0x100000001B3 + key[i][0] + j + 1) % 2**64], np.uint64))[0])
        out.append(t >> 32)
    return np.array(out, np.uint32)


@pytest.mark.parametrize("text", ["", "a", "abcdefg", "abcdefgh", "abcabcabcabcabc", "hello world, hello world!",
                                  "aaaaaaaaaaaaaaaaaaaaaaaa", "é漢🙂" * 9])
@pytest.mark.parametrize("l", [1, 2, 3])
def test_against_brute_force(text, l):  # noqa: E741
    o = fp.OrderMinHash(k=8, m=16, l=l)
    assert (o.fingerprint(text) == slow(text, o)).all()


def test_blocks_change_nothing(monkeypatch):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(5000))
    whole = fp.OrderMinHash().fingerprint(text)
    monkeypatch.setattr(fp, "BLOCK", 100)
    assert (fp.OrderMinHash().fingerprint(text) == whole).all()


def test_order_matters_and_likeness_falls_with_edits():
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(300)]
    o, text = fp.OrderMinHash(m=256), " ".join(words)
    base = o.fingerprint(text)
    near = [fp.likeness(base, o.fingerprint(" ".join(words[:300 - n] + [w[::-1] for w in words[300 - n:]])))
            for n in (0, 20, 100, 250)]
    assert near[0] == 1.0 and near == sorted(near, reverse=True)
    moved = fp.likeness(base, o.fingerprint(" ".join(words[150:] + words[:150])))
    assert moved < 0.75  # the same k-mers but for two places


def expected(rows):
    o, out = fp.OrderMinHash(), []
    rows = sorted(((d is not None, d or 0, t or "") for d, t in rows), key=lambda r: (-r[0], -r[1], r[2]))
    for i, (has, d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][2]
        q = len(t) // 3
        e = t[:len(t) - q] + nxt[:q]
        a, b = o.fingerprint(t), o.fingerprint(e)
        out.append((d if has else None, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.as_text(a), fp.as_text(b),
                    fp.likeness(a, b), fp.likeness(a, o.fingerprint(nxt))))
    return sorted(out, key=str)


def test_edited_pairs_of_odd_documents(odd_docs, no_docs):
    got = sorted((tuple(r) for r in fp.edited_pairs(texts(odd_docs)).collect()), key=str)
    assert got == expected([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert fp.edited_pairs(texts(no_docs)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 300])
def test_successors_over_many_ranges(spark, odd_docs, n):
    docs = spark.range(n).select((F.col("id") * 7 % 1009).alias("doc_id"),
                                 F.concat(F.lit("text number "), F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("text"))
    got = sorted((tuple(r) for r in fp.edited_pairs(docs).collect()), key=str)
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_equal_texts_have_equal_fingerprints(odd_docs):
    rows = fp.fingerprints(texts(odd_docs)).collect()
    by_id = {r.doc_id: r.fingerprint for r in rows}
    assert by_id[10] == by_id[11] and by_id[0] == by_id[1] != by_id[2]
