"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, per operator."""

import pytest
from helpers import EDGE_ROWS, edge, empty

import corpus_pipeline
from perigee.llm import decontam, html, lm, neardup, pieces, pii, quality, sharding, toxicity

N = len(EDGE_ROWS)


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary.load()


def _labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int")


def _bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (4, "alpha1 beta1 gamma1 alpha2 beta2 gamma2")], "item_id bigint, text string")


def _per_row(spark, vocab):
    return {
        "lm": lm.lm_scores,
        "sample": lambda d: pieces.sampled_encoding(d, vocab),
        "counts": lambda d: pieces.token_counts(d, vocab),
        "shards": sharding.shard_documents,
        "pii": pii.pii_report,
        "neardup": neardup.near_components,
        "toxicity": lambda d: toxicity.toxicity_scores(d, _labels(spark)),
        "quality": quality.quality_report,
        "surrogate": pii.surrogate_pii,
    }


@pytest.mark.parametrize("name", ["lm", "sample", "counts", "shards", "pii", "neardup", "toxicity", "quality", "surrogate"])
def test_a_row_for_every_row(spark, vocab, name):
    f = _per_row(spark, vocab)[name]
    rows = f(edge(spark)).collect()
    assert len(rows) == N
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in EDGE_ROWS)
    assert f(empty(spark)).collect() == []


def test_stages_keep_the_columns(spark):
    d = edge(spark)
    for f in (
        quality.keep_clean,
        neardup.drop_near_duplicates,
        pii.surrogate_pii,
        lambda x: decontam.drop_contaminated(x, _bench(spark)),
    ):
        out = f(d)
        assert out.columns == d.columns and out.dtypes == d.dtypes
        assert {tuple(r) for r in out.collect()} <= set(EDGE_ROWS)
        assert f(empty(spark)).collect() == []


def test_near_duplicates_of_edges(spark):
    rows = neardup.near_components(edge(spark)).collect()
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in rows}
    assert got[(1, 86)] == (1, True) and got[(2, 87)] == (1, False) and got[(3, 86)] == (1, False)
    assert got[(None, 86)] == (1, False)  # a null id with the text of others
    assert got[(None, 0)] == (None, True) and got[(4, 0)] == (4, True) and got[(5, 0)] == (5, True)
    assert got[(8, 1)] == (8, True)
    kept = neardup.drop_near_duplicates(edge(spark)).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 4, 5, 6, 7, 8, 9]


def test_quality_of_edges(spark):
    rows = {r["doc_id"]: r for r in quality.quality_report(edge(spark)).collect() if r["doc_id"]}
    assert rows[4]["n_words"] == 0 and rows[4]["base_failed"] and not rows[4]["kept"]
    assert rows[1]["kept"] and rows[1]["n_repeat_words"] == 0
    assert rows[7]["n_words"] == 30_000 and rows[7]["n_repeat_words"] == 30_000 and rows[7]["base_failed"]


def test_decontamination_of_edges(spark):
    out = decontam.leaks(edge(spark), _bench(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(1, 4), (2, 4), (3, 4), (None, 4)}
    assert {(r["start"], r["similarity"]) for r in out} == {(3, 1.0)}
    assert decontam.leaks(empty(spark), _bench(spark)).collect() == []
    assert decontam.leaks(edge(spark), _bench(spark).where("item_id < 0")).collect() == []


def test_html_edges(spark):
    schema = "page_id bigint, url string, html string, lines int, place string"
    rows = [(1, None, "<p>a</p>", 1, "x"), (2, "", None, 1, "x"), (3, "http://h/x", "", 1, "x"), (None, "http://h/x", "<p>b", 1, "x"),
            (4, "http://h/y", "<p>c</p>", 1, "x"), (4, "http://h/y", "<p>c</p>", 1, "x"), (5, "not a url", "plain", 1, "x")]
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.extract(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, "b", 1), (1, "a", 1), (2, "", 0), (3, "", 0), (4, "c", 1), (4, "c", 1), (5, "plain", 5)]
    assert html.extract(spark.createDataFrame([], schema)).collect() == []


def test_pipeline_stages_on_edges(spark, tmp_path):
    _bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    d = edge(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == d.columns
        d = spark.read.parquet(path)
    assert {r["doc_id"] for r in d.collect()} <= {1, 2, 3, 7, None}


def test_members_of_the_same_lists_go_through_them_once(spark):
    copies = [(i, list(range(45))) for i in range(1000)]
    members = spark.createDataFrame([*copies, (2000, [44, 50]), (3000, [50]), (4000, [60])], "cls bigint, keys array<bigint>")
    edges = neardup._joining(members)
    assert edges.count() <= members.count() + 45 + 4
    families = neardup._families(edges, 512).collect()
    assert {r["cls"]: r["family"] for r in families} == {i: 0 for i in [*range(1000), 2000, 3000]}


def test_op1_learns_from_long_texts(spark, monkeypatch):
    seen = []
    learned = lm._learned_mixer
    monkeypatch.setattr(lm, "_learned_mixer", lambda *a: seen.append(learned(*a)) or seen[-1])
    docs = [(i, " ".join(f"w{(k * k + i) % 97}" for k in range(9000))) for i in range(6)]
    assert lm.lm_scores(spark.createDataFrame(docs, "doc_id bigint, text string")).count() == 6
    assert not (seen[0].w == lm.SourceMixer().w).all()
