import corpus_pipeline as P
import pytest

from plantpulse.llm import QUERIES, pii
from tests.conftest import SF_SMALL
from tests.llm.test_neardup import brute, shingles
from tests.llm.test_packing import check


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage, written and read again."""
    from plantpulse.llm.common import prepare, scratch

    prepare(spark)
    out = [spark.read.parquet(f"{SF_SMALL}/documents.parquet")]
    for name, stage in P.STAGES:
        out.append(scratch(stage(spark, out[-1], SF_SMALL), name))
    return out


def test_stage_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "personal_data", "packing"]
    assert all(s.schema.names == stages[0].schema.names for s in stages[:-1])


def test_quality_keeps_clean_documents(spark, stages):
    kept = {r.doc_id for r in stages[1].collect()}
    scores = {r.doc_id: r.score for r in QUERIES["op1_quality_classifier"](spark, SF_SMALL).collect()}
    assert kept == {i for i, s in scores.items() if s >= 0.3}
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    bad = [r.doc_id in kept for r in labels if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = brute(rows, 5, 80)
    assert {r.doc_id for r in stages[2].collect()} == {i for i, c in want.items() if i == c}
    assert shingles("a b c d e", 5)


def test_personal_data_is_masked(stages):
    before = {r.doc_id: r.text for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert not pii.base_spans(after[i].text)
        if not pii.MARKED.search(t):
            assert after[i].text == t


def test_packing_covers_the_last_documents(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r.doc_id: [*ref.encode(r.text, add_special_tokens=False).ids, 1] for r in stages[3].collect()}
    pieces = [(r.doc_id, r.start, bytes(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in stages[4].collect()]
    assert check(pieces, docs, 2048) <= 0.01 * sum(map(len, docs.values()))


def test_stages_stand_odd_documents(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 0), (10, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd_docs.columns, name
        P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


def test_run_gives_the_last_stage(spark, stages):
    own = sorted((r.doc_id, r.start, r.length) for r in P.run(spark, SF_SMALL).collect())
    docs = {}
    for i, s, n in own:
        docs.setdefault(i, []).append((s, n))
    want = {}
    for r in stages[4].collect():
        want.setdefault(r.doc_id, set()).add(r.doc_tokens)
    assert docs.keys() == want.keys()
    assert all(sum(n for _, n in p) in want[i] for i, p in docs.items())


def test_packing_leaves_no_tokenizer_in_waiting_workers(spark):
    import pyarrow as pa

    from plantpulse.llm.common import prepare

    def held(batches):
        import sys
        n = sum(b.num_rows for b in batches)
        tokens = sys.modules.get("plantpulse.llm.tokens")
        yield pa.RecordBatch.from_pydict({"n": [n], "kept": [len(tokens._TOKENIZERS) if tokens else 0]})
    prepare(spark)
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('some words ', id) AS text").repartition(32)
    docs = P.good_documents(spark, docs, SF_SMALL).select("doc_id", "text").unionByName(docs)  # drops what is held
    assert P.packed(spark, docs, SF_SMALL).count() >= 200
    probe = spark.range(400).repartition(64).mapInArrow(held, "n long, kept long").collect()
    assert sum(r.n for r in probe) == 400 and not any(r.kept for r in probe)
