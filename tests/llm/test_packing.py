import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantpulse.llm import packing
from plantpulse.llm.common import texts
from plantpulse.llm.tokens import ChunkTokenizer

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module", params=[("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)], ids=["word", "byte"])
def both(request):
    from tokenizers import Tokenizer

    name, lead = request.param
    ref = Tokenizer.from_file(P.path(name))
    return ChunkTokenizer(P.path(name), lead), ref


@given(st.lists(st.text(alphabet="abehnrstAB'.,!?\n\t 019_éßΣİñ漢🙂\xa0\x1c", max_size=60), max_size=6))
@settings(max_examples=300, deadline=None)
def test_chunked_ids_equal_whole_texts(both, parts):
    own, ref = both
    parts = [*parts, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y", " <|startoftext|><|endoftext|> É<|ENDOFTEXT|> ",
             "  two  spaces, and. "]
    flat, sizes = own.encode_batch(parts, 1)
    want = [[*ref.encode(t, add_special_tokens=False).ids, 1] for t in parts]
    assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == sum(want, [])


def test_letters_that_compose_with_marks():
    """J, H, T, W and Y compose with these marks only as small letters, after
    the library has composed: their texts are not lower-cased beforehand."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own, ref = ChunkTokenizer(path, False), Tokenizer.from_file(path)
    marked = ["J\u030cA ab\u0331 H\u0331 T\u0308.", "W\u030a, Y\u030a É", "I\u0307 İ. ΑΣ, ß", "Words, WORDS. words", "ÄÖ Äö, äö.",
              "A <|ENDOFTEXT|> b", "<|EndOfText|>"]  # capitals are no special token, though small letters are
    flat, sizes = own.encode_batch(marked, 1)
    want = [[*ref.encode(t, add_special_tokens=False).ids, 1] for t in marked]
    assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == sum(want, [])


def test_forms_of_a_word_are_held_once():
    """Capital forms took an entry each, and time to find the word's own."""
    own = ChunkTokenizer(P.path("word_bpe_49k.json"), False)
    own.encode_batch(["pump Pump PUMP pUmp ßé SSé PUMPé Pumpé"], 1)
    assert set(own.new) == {"pump", "ßé", "ssé", "pumpé"}


def test_a_dropped_cache_goes_back_to_the_system():
    """Idle workers lie beside the executor's heap: the next stage's limit."""
    import subprocess
    import sys

    code = ("import public_tokenizers as P; from plantpulse.llm import tokens\n"
            "def rss(): return int(open('/proc/self/statm').read().split()[1]) * 4 // 1024\n"
            "tok = tokens.worker_tokenizer(P.path('word_bpe_49k.json'), False, 40 << 20); base = rss()\n"
            "for a in range(12): tok.encode_batch([' '.join(f'{i:x}w{a}' for i in range(20000))], 1)\n"
            "full = rss(); del tok; tokens.forget(); print(base, full, rss())")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True,
                         cwd=os.path.dirname(os.path.dirname(packing.__file__)) + "/..", timeout=120)
    base, full, left = map(int, out.stdout.split())
    assert full > base + 20 and left < base + 5, out.stdout


def check(pieces, docs, capacity):
    """Every id in one piece, gapless sequences, padding as promised."""
    seqs, by_doc = defaultdict(list), defaultdict(list)
    for doc, start, ids, n, seq, off in pieces:
        assert n == len(docs[doc]) and len(ids)
        seqs[seq].append((off, len(ids) // 4))
        by_doc[doc].append((start, np.frombuffer(ids, "<u4")))
    for doc, ids in docs.items():
        own = sorted(by_doc[doc], key=lambda p: p[0])
        at = 0
        for start, part in own:
            assert start == at
            at += len(part)
        assert np.concatenate([p for _, p in own]).tolist() == list(ids)
    waste = 0
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
        waste += 0 if at & (at - 1) == 0 else capacity - at
    return waste


@given(st.lists(st.integers(1, 300), max_size=60), st.sampled_from([16, 64, 60]))
@settings(max_examples=150, deadline=None)
def test_packer_keeps_every_id(lengths, capacity):
    packer = packing.HarmonicPacker(capacity, 5)
    sizes = np.array(lengths, np.int64)
    flat = np.arange(sizes.sum(), dtype="<u4")
    rows = packer.add(range(len(lengths)), flat, sizes) + packer.close()
    ends = np.cumsum(sizes)
    waste = check(rows, {i: range(e - n, e) for i, (n, e) in enumerate(zip(lengths, ends))}, capacity)
    assert waste <= 0.12 * max(1, sizes.sum()) or capacity == 60


def test_classes_hold_fixed_counts():
    assert packing.class_sizes(12) == [12, 6, 4, 3, 2, 1]
    cuts = packing.cuts_by_remainder(2048)
    assert all(sum(c) == n for n, c in enumerate(cuts)) and max(map(len, cuts)) <= 5


def test_odd_documents(odd_docs, no_docs):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = {r.doc_id: [*ref.encode(r.text or "", add_special_tokens=False).ids, 1] for r in odd_docs.collect()}
    got = packing.pack(texts(odd_docs.dropDuplicates(["doc_id"])), P.path("word_bpe_49k.json")).collect()
    pieces = [(r.doc_id, r.start, bytes(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in got]
    assert check(pieces, docs, 2048) <= 0.01 * sum(map(len, docs.values()))
    assert packing.pack(texts(no_docs), P.path("word_bpe_49k.json")).count() == 0


def test_query_over_a_table(spark):
    from plantpulse.llm import QUERIES
    from tests.conftest import SF_SMALL
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = {r.doc_id: [*ref.encode(r.text or "", add_special_tokens=False).ids, 1]
            for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    total = 0
    for r in QUERIES["op8_harmonic_packing"](spark, SF_SMALL).collect():
        ids = np.array(docs[r.doc_id][r.start:r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.doc_tokens == len(docs[r.doc_id])
        total += r.length
    assert total == sum(map(len, docs.values()))
