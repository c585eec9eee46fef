"""Every operator over rows that are repeated, null in any column, and carry columns named like its own results."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers as P
from runquarry.llm import bpe, html, minhash, mixing, queries, repeats, token_files, topk, toxicity, urls, vectors

SF = "/root/testdata/sf0.001"
CLASH = ["kept", "score", "component_id", "rounds", "rank", "start", "n_tokens", "n_links", "verdict", "path", "id", "pos", "n", "label_", "_size", "_hash", "k", "t", "b", "u", "v"]


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def docs(spark):
    text = " ".join(f"word{i % 37} and {i}" for i in range(120))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text + " more", None, None), (None, text, "en", "b"), (None, None, None, None), (3, None, "de", "b"),
            (4, "", "de", "b"), (5, " \t\n", "de", None), (6, "tie", "fr", "c"), (7, "tie", "fr", "c"), (8, "x" * 20000, "fr", "c")]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return clashing(df)


def test_texts(spark, docs, tmp_path):
    n = docs.count()
    mixed = mixing.mix_sources(docs, F.array("source"), F.length("text"), {"a": 2000.0, "b": 2000.0, None: 2000.0, "c": 5.0})
    assert mixed.columns == [c for c in docs.columns if c != "rounds"] + ["rounds"] and mixed.count() == n
    assert mixed.where("doc_id = 1").select("rounds").distinct().count() == 1
    rows = minhash.near_duplicate_texts(docs, words=3, percent=85).collect()
    assert len(rows) == n and {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1} and {r["n_shingles"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert {r["component_id"] for r in rows if r["doc_id"] == 7} == {6}
    assert bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).where("n_tokens is not null").count() == n
    token_files.write_token_files(docs, str(tmp_path / "t"), P.path("byte_bpe_50k.json"), end_id=2)
    found = token_files.read_token_files(spark, str(tmp_path / "t"), digest=True).collect()
    assert len(found) == n and sorted(r["start"] for r in found)[0] == 0
    ends = sorted((r["start"], r["n_tokens"]) for r in found)
    assert all(a + length == b for (a, length), (b, _) in zip(ends, ends[1:]))
    cut = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect()}
    assert cut[1]["n_removed"] == cut[1]["n_bytes"] and cut[3]["n_bytes"] == cut[3]["n_removed"] == 0 and cut[8]["n_removed"] == 20000
    model = toxicity.fit_toxicity(docs.withColumn("y", F.col("doc_id") % 2), "doc_id", "text", "y")
    scored = toxicity.score_toxicity(docs, model)
    assert scored.count() == n and scored.where("score is null or isnan(score)").isEmpty()


def test_vectors_and_terms(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (None, None, None), (4, [0.0, 0.0], 1), (20, [0.5, 0.5], 2)]
    df = clashing(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    out = vectors.near_duplicate_vectors(df, threshold=0.98).collect()
    assert len(out) == len(rows) and {r["component_id"] for r in out if r["vec_id"] == 2} == {1} and {r["n_links"] for r in out if r["vec_id"] in (3, 4, 20)} == {0}
    terms = df.withColumn("terms", topk.integer_terms(F.col("embedding"), 64))
    best = topk.top_k(terms, terms.where("vec_id % 20 = 0"), "vec_id", "terms", k=2).collect()
    assert [(r["query_id"], r["rank"], r["score"]) for r in sorted(best, key=lambda r: r["rank"])] == [(20, 1, 2048), (20, 2, 2048)]


def test_pages(spark):
    rows = [(1, "http://a.org/x", "<article><p>hello there</article>"), (1, "http://a.org/x", "<article><p>hello there</article>"), (None, None, None), (2, "://", ""), (3, "", "<p>" * 3)]
    df = clashing(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert sorted(r["text"] for r in html.extract_text(df).collect()) == ["", "", "", "hello there", "hello there"]
    labels = clashing(spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, quality int"))
    judged = urls.judge_urls(df, queries.URL_RULES, labels, outcome_key="doc_id", outcome="quality")
    assert judged.count() == len(rows) and judged.where("verdict not in ('allow', 'block') or host is null").isEmpty()


def test_stages(spark, docs, tmp_path):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count()


def test_repeated_rows_stay_once(spark, docs, tmp_path):
    text, now = docs.where("doc_id = 1").first()["text"], docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert [r["text"] for r in now.where("doc_id = 1").collect()] == [text], name
            assert sorted(r["doc_id"] or 0 for r in now.collect()) == [0, 1, 3, 4, 5, 6, 8], name
    assert [r["text"] for r in now.where("doc_id = 1").distinct().collect()] == [text]
