import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from plantpulse.llm import bpe
from plantpulse.llm.common import texts

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(PATH)
    return bpe.worker_encoder(PATH, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks,
                                                                  special_tokens={})


@given(st.text(alphabet="abehinorst AB'.,!?\n\t 019_éßñ漢🙂\xa0", max_size=80))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_library(both, text):
    own, ref = both
    ids = own.encode(text)
    assert ids == ref.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 4000, " " * 999 + "x", "\n" * 300, "the" * 2000, "ab" * 3000, "0123456789" * 300,
                                  "zqxj" * 500, "é" * 1500])
def test_long_runs(both, text):
    own, ref = both
    assert own.encode(text) == ref.encode_ordinary(text)


def test_odd_documents(both, odd_docs, no_docs):
    own, ref = both
    got = bpe.decode(bpe.encode(texts(odd_docs), PATH, P.PATTERN), PATH, P.PATTERN).collect()
    want = sorted((r.text or "", ref.encode_ordinary(r.text or "")) for r in odd_docs.collect())
    assert sorted((bytes(r.decoded).decode(), r.ids) for r in got) == want
    assert bpe.encode(texts(no_docs), PATH, P.PATTERN).count() == 0


def test_query_digests(spark, tmp_path, odd_docs):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    from plantpulse.llm import QUERIES

    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op7_byte_bpe"](spark, str(tmp_path)).collect())
    want = []
    for r in odd_docs.collect():
        t = r.text or ""
        ids = ref.encode_ordinary(t)
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
