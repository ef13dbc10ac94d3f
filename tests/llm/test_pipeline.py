"""Each stage of the pipeline against what it should have kept."""

from collections import Counter

import pytest

pytest.importorskip("tidemark.llm")
from conftest import DATA

import corpus_pipeline
from tidemark.llm import mixing, pieces, queries, simhash


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "1234 5678", None, None, 9), (10**6 + 1, None, None, None, None), (10**6 + 2, "", "en", "src1", 0)], docs.schema)
    stages = [f for _, f in corpus_pipeline.STAGES]
    first = stages[0](spark, docs.union(extra), DATA)
    assert first.columns == docs.columns
    assert sorted(r.doc_id for r in first.collect()) == sorted(r.doc_id for r in docs.collect())
    again = first.union(first.limit(3))
    second = stages[1](spark, again, DATA)
    groups = {r.component_id for r in simhash.components(first).collect()}
    assert second.columns == docs.columns and sorted(r.doc_id for r in second.collect()) == sorted(groups)
    third = stages[2](spark, second, DATA)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(second).collect()}
    copies = Counter(r.doc_id for r in third.collect())
    assert third.columns == docs.columns and all(taken[i][0] // taken[i][1] <= n <= -(-taken[i][0] // taken[i][1]) for i, n in copies.items())
    assert all(i in copies for i, (t, s) in taken.items() if s and t >= s)
    fourth = stages[3](spark, third, DATA)
    library = pieces.load(queries.vocabulary()).library
    text = {r.doc_id: r.text for r in third.collect()}
    assert all(r.n_tokens == len(library.encode(text[r.doc_id])) + 1 for r in fourth.collect()) and fourth.count() == sum(copies.values())


def test_stages_take_any_columns_and_nulls(spark):
    """Extra columns may be called like the stages' own; rows without an id are neither lost nor multiplied."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, _id long, _copies string, _again boolean, _p0 int, cell int"
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"{words} number{i} " * (i + 1), "en", "a", 1, 5, "x", True, i, 0) for i in range(4)]
    rows += [(None, f"plain text without an id {'again ' * 7}{k}", "en", "a", None, None, None, None, None, None) for k in "uvw"]
    rows += [(9, None, None, None, None, None, None, None, None, None), (10, "", "en", None, 0, 1, "", False, 1, 1)]
    docs = spark.createDataFrame(rows, kind)
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= set(rows)
    same_weights = mixing.mixed_documents(docs.union(docs.where("doc_id is null")), weights=(1,), cap=1)
    assert Counter(r.text for r in same_weights.collect()) == Counter(r[1] for r in rows if r[1]) + Counter(r[1] for r in rows if r[0] is None)


def test_run_and_empty(spark, tmp_path):
    whole = corpus_pipeline.run(spark, DATA)
    assert whole.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and whole.count() > 0
    spark.read.parquet(f"{DATA}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_languages_never_learned_go_and_clean_documents_stay(spark):
    import base64
    import random
    import zlib

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    unseen = [
        "Съешь ещё этих мягких французских булок, да выпей чаю. Все люди рождаются свободными и равными.",
        "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
        "def f(x):\n    return [i for i in range(x) if i % 2 == 0]\nclass A(B):\n    def __init__(self, a=1): self.a = a\n" * 5,
        base64.b64encode(random.Random(1).randbytes(600)).decode(),
    ]
    extra = spark.createDataFrame([(10**6 + k, t, None, "src1", len(t)) for k, t in enumerate(unseen)], docs.schema)
    one = docs.where("lang = 'en'")
    for frame in (docs, one):
        kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, frame.union(extra), DATA).collect()}
        own = {r.doc_id for r in frame.collect()}
        assert any(zlib.crc32(str(i).encode()) % 4 == 2 for i in own) and kept == own
