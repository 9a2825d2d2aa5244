"""The pipeline's stages against brute-force versions of each."""

import hashlib
import struct
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from jobsift.llm import queries, toxicity  # noqa: E402
from jobsift.llm.sampling import fold  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    base = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out[name] = (before, docs.collect())
        assert name == "bpe" or docs.columns == COLUMNS
    return out


def test_stages_follow_each_other(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "bpe"]


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), fold("id", 3) != 1)
    judge = model.scorer()
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if judge(r.text) < 0.7)


def test_lines_go(stages):
    before, after = stages["line_dedup"]
    clean = brute.line_dedup([(r.source, r.text) for r in before])
    assert sorted(map(tuple, after)) == sorted((r.doc_id, t, r.lang, r.source, len(t)) for r, t in zip(before, clean))


def test_one_of_each_group_stays(stages):
    before, after = stages["simhash"]
    found = brute.classes([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in found})


def test_the_mix_has_each_document_as_often_as_taken(stages):
    before, after = stages["mixing"]
    taken = {d: t // n for d, n, _, _, t in brute.mix([(r.doc_id, r.source, r.text) for r in before]) if n}
    assert Counter(r.doc_id for r in after) == Counter({d: n for d, n in taken.items() if n})


def test_tokens(stages):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(queries.tokenizer_path())
    before, after = stages["bpe"]
    want = []
    for r in before:
        ids = lib.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, after)) == sorted(want)


def test_stages_take_awkward_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, score long"
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "a", 0, 1, 1), (1, "", "en", "a", 0, 1, 1),
            (2, "some words " * 30000, "en", "a", 1, 1, 1), (3, "a b c", None, "b", 1, 1, 1)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.collect()
