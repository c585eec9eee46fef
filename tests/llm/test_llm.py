"""Operators against brute force on small rows: nulls, empty and long texts, ties, repeated rows, clashing names."""

import base64
import hashlib
import random
import re
import zlib
from html import unescape

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracles import compare, connect
from runquarry.llm import bpe, html, minhash, mixing, queries, repeats, token_files, topk, toxicity, urls, vectors

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def odd_docs(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    near = [*base[:60], "changed", *base[61:]]
    rows = [(1, " ".join(base), "a"), (2, " ".join(base), "b"), (3, " ".join(near), None), (4, None, "a"), (5, "", "a"), (6, "one", "a"), (7, "ONE", None),
            (8, "x" * 3000, "b"), (9, "é日本 \t\n 🎉" * 50, "c"), (None, " ".join(base), "a"), (10, "tiny two", "b"), (11, " ".join(rng.choice(words) for _ in range(5000)), "b")]
    return spark.createDataFrame([(*r, "own", 1.5) for r in rows], "doc_id bigint, text string, source string, kept string, score double")


def test_queries_match_sql(spark):
    con = connect(SF)
    for name, sql in queries.oracle_sql().items():
        message, same = compare(spark, con, SF, name, queries.queries()[name], sql)
        assert same, f"{name} {message}"


def test_targets_and_flow():
    assert mixing.capped_targets({"a": 100, "b": 1000, None: 50}, [5, 2, 1], 1.5) == {"a": 200.0, None: 100.0, "b": 1425.0}
    assert mixing.capped_targets({}, [5]) == {}
    flow = mixing.route({("a",): 10, ("b",): 10, ("a", "b"): 10}, {"a": 25, "b": 5}, 2)
    assert sum(v for (_, s), v in flow.items() if s == "a") == 25 and sum(v for (_, s), v in flow.items() if s == "b") == 5


def test_disjoint_sources_take_the_flow(monkeypatch):
    solved, solve = [], mixing._route_connected
    monkeypatch.setattr(mixing, "_route_connected", lambda patterns, *rest: solved.append(sorted(map(str, patterns))) or solve(patterns, *rest))
    capacity = {("a",): 10, ("b",): 7, (None,): 4, ("c", "d"): 5, ("d", "e"): 5, (): 3}
    flow = mixing.route(capacity, {"a": 15.5, "b": 30, None: 0, "c": 4, "e": 9}, 2)
    assert flow == {(("a",), "a"): 15.5, (("b",), "b"): 14.0, (("c", "d"), "c"): 4, (("d", "e"), "e"): 9}
    assert sorted(solved) == [["('a',)"], ["('b',)"], ["('c', 'd')", "('d', 'e')"], ["(None,)"]]
    many = {(f"s{i}",): i for i in range(20000)}
    assert mixing.route(many, {f"s{i}": 1.5 * i for i in range(20000)}, 2) == {((f"s{i}",), f"s{i}"): 1.5 * i for i in range(1, 20000)}


def test_mix_takes_near_the_target(spark):
    rows = queries.op1_mix_sources(spark, SF)
    docs = by(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    total, targets = {}, {}
    for r in rows.collect():
        assert r["size"] == len(WORD.findall(docs[r["doc_id"]]["text"] or "")) and r["taken"] <= 2 * r["size"]
        s = docs[r["doc_id"]]["source"]
        total[s], targets[s] = total.get(s, 0) + r["taken"], r["target"]
    assert all(abs(total[s] - targets[s]) <= 0.05 * targets[s] for s in total)


def test_source_without_words_keeps_its_place(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", "a")] + [(10 + i, "one two three four five", s) for i in range(400) for s in "bcd"]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["source"]: r for r in queries.mixed(df).groupBy("source").agg(F.max("_rq_source_size").alias("size"), F.max("_rq_target").alias("target"),
                                                                          F.sum(F.col("_rq_size") * F.col("_rq_rounds")).alias("taken")).collect()}
    assert {s: (r["size"], round(r["target"])) for s, r in got.items()} == {"a": (0, 0), "b": (2000, 3333), "c": (2000, 1667), "d": (2000, 4000)}  # weights 5, 2, 1, 5
    assert got["a"]["taken"] == 0 and all(abs(got[s]["taken"] - got[s]["target"]) <= 5 for s in "bcd")


def test_mix_of_odd_rows(spark, odd_docs):
    out = mixing.mix_sources(odd_docs, F.array("source"), F.length("text"), {"a": 300.0, "b": 10.0, None: 3.0, "none": 9.0})
    assert out.columns == [*odd_docs.columns, "rounds"] and out.count() == odd_docs.count()
    assert all(r["rounds"] == 0 for r in out.where("text is null or text = ''").collect())
    assert mixing.mix_sources(odd_docs.limit(0), F.array("source"), F.length("text"), {}).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in base[i % 40] * (1 + i) + rng.normal(size=8) * 0.02 * (i % 3)], i % 2) for i in range(160)]
    odd = [(200, None, 1), (201, [0.0] * 8, 1), (202, [1.0, None] + [0.0] * 6, 1), (203, [float("nan")] * 8, 1), (204, [float("inf")] * 8, 1), (205, rows[0][1], None)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    component = np.arange(len(rows))
    for _ in rows:
        component = np.minimum(component, np.where(linked, component[None], 10**6).min(1))
    for options in ({}, {"cell_rows": 10, "block_rows": 7}):
        got = by(vectors.near_duplicate_vectors(df, **options), "vec_id")
        assert [got[i]["n_links"] for i in range(160)] == linked.sum(1).tolist()
        assert [got[i]["component_id"] for i in range(160)] == component.tolist()
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(200, 206))
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_topk(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-2, 3) if rng.random() < 0.4 else 0 for _ in range(6)]) for i in range(90)]
    df = spark.createDataFrame(rows + [(None, [1] * 6), (95, None)], "vec_id bigint, terms array<bigint>")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), "vec_id", "terms", 7, candidate_rows=20, query_rows=2).collect()
    want = []
    for q, t in rows[::20]:
        order = sorted((-sum(a * b for a, b in zip(t, u)), i) for i, u in rows if i != q)[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), df, "vec_id", "terms").count() == 0
    assert spark.createDataFrame([([1.5, -0.01],), ([None],), (None,)], "v array<double>").select(topk.integer_terms(F.col("v"))).collect() == [([96, -1],), (None,), (None,)]


def test_bpe_like_tiktoken(odd_docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode_decode(odd_docs, path, P.PATTERN, keep_ids=True).collect()}
    for r in odd_docs.collect():
        ids = own.encode_ordinary(r["text"] or "")
        g = got[r["doc_id"]]
        assert g["ids"] == ids and bytes(g["decoded"]) == (r["text"] or "").encode() and g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_decode(odd_docs.limit(0), path, P.PATTERN).count() == 0


def test_token_files(spark, odd_docs, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t, start = Tokenizer.from_file(path), 0
    token_files.write_token_files(odd_docs, str(tmp_path / "t"), path, end_id=2, block_bytes=500)
    got = {r["doc_id"]: r for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect()}
    digests = {r["doc_id"]: r for r in token_files.read_token_files(spark, str(tmp_path / "t"), digest=True).collect()}
    for r in sorted(odd_docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        g, d = got[r["doc_id"]], digests[r["doc_id"]]
        assert g["ids"] == ids and g["start"] == start == d["start"] and d["n_tokens"] == len(ids)
        assert d["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("ids", [[], [1], [0] * 500, [2**60 - 1, 0, 5], [5] * 1024 + [2**59] * 3, [2**33] * 1500, list(range(3000))])
def test_simple8b_round_trip(ids):
    words, offsets = token_files.pack(np.array(ids, dtype=np.uint64))
    assert token_files.unpack(words, offsets, len(ids)).tolist() == ids
    with pytest.raises(ValueError):
        token_files.pack(np.array([2**60], dtype=np.uint64))


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_minhash(spark, odd_docs, words, percent):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    family = []
    for i in range(60):
        some = list(base)
        for _ in range(rng.randrange(0, 7)):
            some[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        family.append((100 + i, " ".join(some)))
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + family
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    component = {i: i for i in sets}
    ids = [i for i in sets if i is not None and sets[i]]
    for _ in range(8):
        for a in ids:
            for b in ids:
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    component[a] = component[b] = min(component[a], component[b])
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for options in ({}, {"star_rounds": 0, "block_shingles": 700}):
        got = by(minhash.near_duplicate_texts(df, words=words, percent=percent, **options), "doc_id")
        for i, s in sets.items():
            assert got[i]["n_shingles"] == len(s) and got[i]["component_id"] == component[i] and got[i]["kept"] == (component[i] == i)
    assert minhash.near_duplicate_texts(df.limit(0)).count() == 0


def test_url_rules_and_reputation(spark):
    rules = queries.URL_RULES
    rows = [(1, "http://A.Example.ORG/en/17?x"), (2, "https://x.com/de/1"), (3, "https://com/fr/"), (4, "//nohost"), (5, None), (6, "http://xexample.org/es/"),
            (7, "http://bad.net/p#a"), (8, "http://good.net"), (9, "http://new.bad.net/")] + [(100 + i, f"http://bad.net/{i}") for i in range(40)]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id bigint, url string, verdict string")
    labels = spark.createDataFrame([(100 + i, 0) for i in range(40)] + [(8, 1), (1, None), (None, 1)], "page_id bigint, good int")
    got = by(urls.judge_urls(pages, rules, labels), "page_id")
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in (1, 2, 3, 4, 5, 6, 8)] == [
        ("a.example.org", "/en/17", "example.org/en/1"), ("x.com", "/de/1", "com/de/"), ("com", "/fr/", "com/fr/"), ("", "", None), ("", "", None),
        ("xexample.org", "/es/", "org/"), ("good.net", "", None)]
    assert got[1]["verdict"] == "block" and got[6]["verdict"] == "allow" and got[7]["verdict"] == "block" and got[105]["verdict"] == "block"
    assert got[105]["host_high"] < 0.5 < got[8]["host_high"] and len(got) == len(rows)
    assert by(urls.judge_urls(pages, rules, labels.limit(0)), "page_id")[7]["verdict"] == "allow"
    assert urls.judge_urls(pages.limit(0), rules, labels).count() == 0


def test_html(spark):
    page = ('<body><header>x</header><div class="sidebar">a</div><div id=content><h2>T</h2><p>Hello <i>wo</i>rld, it&nbsp;is &lt;b&gt;.<ul><li>one<li>two</ul>'
            '<script>var a="</p>"</script></div><div class="user-comments"><p>no</p></div><form>f</form><p')
    assert html.main_text(page) == "T\nHello world, it is <b>.\none\ntwo"
    assert html.main_text("") == "" and html.main_text("<nav>a</nav>") == "" and html.main_text("plain  text") == "plain text"
    assert html.main_text("<article><p>" + "long text. " * 20000 + "</article>").startswith("long text. long")
    assert html.main_text("<div>" * 5000 + "deep") == "deep"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", "")], "page_id bigint, url string, html string")
    assert sorted((r["url"] or "", r["n_chars"]) for r in html.extract_text(df).collect()) == [("", 0), ("u", len(html.main_text(page))), ("v", 0)]
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"</?b>", "", t)).split()) for t in re.split(r"</?(?:p|h1|br)>", body)]
        assert html.main_text(r["html"]) == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("length, marks", [(100, 2), (600, 10), (1200, 20), (3000, 60)])
@pytest.mark.parametrize("holder", ["article", "main", 'div id="content"'])
def test_html_short_blocks_beside_long_paragraphs(length, marks, holder):
    part = "w" * (length // marks - 1) + "."
    short = [f"{i} " + "item" * 7 for i in range(3)], [f"cell {i} value" for i in range(4)]
    page = (f"<nav>a</nav><{holder}><h1>Title</h1>" + f"<p>{part * marks}</p>" * 4 + "<ul>" + "".join(f"<li>{x}</li>" for x in short[0]) + "</ul><div><div><table>"
            + "".join(f"<tr><td>{x}</td></tr>" for x in short[1]) + f"</table></div></div></{holder.split()[0]}><section><div><ul><li>aloof</ul></div></section><footer>b</footer>")
    want = ["Title", *[part * marks] * 4, *short[0], *short[1]]
    got = html.main_text(page).split("\n")
    assert got == want or holder.startswith("div") and length == 100 and got == [*want, "aloof"]


def test_html_marked_wrappers():
    text = "<h2>T</h2><p>" + "Some words, and more. " * 20 + "</p>"
    want = "T\n" + " ".join("Some words, and more. ".split() * 20)
    around = '<nav>a b</nav><div class="sidebar">c d</div><div class="comments"><p>' + "No, never. " * 20 + "</p></div>"
    for before, after in [('<div class="layout has-sidebar">', "</div>"), ('<div id="page" class="nav-open">', "</div>"), ("<form>", "</form>"), ('<div class="comments-open">', "</div>")]:
        for inner in ("article", "main", "div"):
            page = f"{before}<{inner}>{text}</{inner}>{around}{after}<footer>e</footer>"
            assert html.main_text(page) == want, page
    assert html.main_text(f'<form><div class="has-sidebar"><div class="nav-open">{text}</div>{around}</div></form>') == want
    assert html.main_text(f'<aside><article>{text}</article></aside>') == want
    assert html.main_text(f'<article>{text}</article><div class="comments"><article>{text}</article></div><aside><article>x</article></aside>') == want
    head = '<div class="entry-header"><h1>Head</h1></div>'
    for page in (f"<article>{head}{text}</article>", f'<main><h1 class="banner">Head</h1>{text}</main>', f'<main><div class="banner"><h1>Head</h1></div>{text}</main>'):
        assert html.main_text(page) == "Head\n" + want, page
    assert html.main_text(f'<article>{text}<div class="newsletter"><h3>No</h3></div><div class="related"><h1>No</h1></div><form>f</form></article>') == want


def test_toxicity_held_out(spark):
    rows = queries.op9_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = ([r for r in rows if r["toxic"] == y] for y in (1, 0))
    assert sum(r["predicted"] for r in bad) > 0.75 * len(bad) and sum(r["predicted"] for r in good) < 0.01 * len(good)


def test_toxicity_of_odd_rows(spark, odd_docs):
    labels = odd_docs.withColumn("y", F.when(F.col("doc_id") < 8, F.col("doc_id") % 2))
    model = toxicity.fit_toxicity(labels, "doc_id", "text", "y")
    out = toxicity.score_toxicity(odd_docs, model)
    assert out.columns == odd_docs.columns and all(0 <= r["score"] <= 1 for r in out.collect())
    one_class = toxicity.fit_toxicity(labels.where("y = 1"), "doc_id", "text", "y")
    assert toxicity.score_toxicity(odd_docs, one_class).select("score").distinct().count() == 1
    assert toxicity.score_toxicity(odd_docs.limit(0), toxicity.fit_toxicity(labels.limit(0), "doc_id", "text", "y")).count() == 0


def test_repeated_windows_of_shards():
    rng = random.Random(3)
    for length in (3, 5, 8, 13):
        for trial in range(15):
            texts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 12))]
            seen = {}
            for t in texts:
                for i in range(len(t) - length + 1):
                    seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
            want = [[i for i in range(len(t) - length + 1) if seen[t[i:i + length]] > 1] for t in texts]
            assert [x.tolist() for x in repeats.repeated_windows(texts, length, rng.choice([20, 100, 10**4]))] == want


@pytest.mark.parametrize("hot_bytes", [0, 1 << 22])
def test_repeats(spark, odd_docs, hot_bytes):
    passage = "".join(random.Random(5).choice("abc é") for _ in range(230))
    more = spark.createDataFrame([(50, "left " + passage + " right", "a", "k", 0.0), (51, passage * 2, "a", "k", 0.0), (52, passage[:199], "a", "k", 0.0)], odd_docs.schema)
    docs = odd_docs.unionByName(more)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    seen = {}
    for t in texts.values():
        for i in range(len(t) - 199):
            seen[t[i:i + 200]] = seen.get(t[i:i + 200], 0) + 1
    got = by(repeats.remove_repeats(docs, hot_bytes=hot_bytes), "doc_id")
    for i, t in texts.items():
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 199):
            if seen[t[a:a + 200]] > 1:
                gone[a:a + 200] = True
        left = bytes(b for b, g in zip(t, gone) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert tuple(got[i])[1:] == (len(t), gone.sum(), spans, hashlib.sha256(left).hexdigest()), i
    kept = repeats.remove_repeats(docs, keep="text", hot_bytes=hot_bytes)
    assert kept.columns == docs.columns and by(kept, "doc_id")[50]["text"].startswith("left ") and by(kept, "doc_id")[4]["text"] is None
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.withColumn("kept", F.lit("x")).withColumn("score", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.columns == extra.columns, name
        out.write.parquet(str(tmp_path / name))
        extra = spark.read.parquet(str(tmp_path / name))
    last = corpus_pipeline.STAGES[-1][1](spark, extra, SF)
    assert last.count() == extra.count() > 0 and last.where("ids_sha256 is null").isEmpty()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
