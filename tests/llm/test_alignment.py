"""Tokenizer alignment against the libraries and a plain walk over the tokens."""

import hashlib
import random
from collections import defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runquarry.llm import alignment, queries
from runquarry.llm.rank_bpe import byte_letters

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """[(id, begin, end)] of both sides, or two empty lists."""
    a, b = libraries
    if not text:
        return [], []
    byte_of = {c: i for i, c in enumerate(byte_letters())}
    found = a.encode(" " + text, add_special_tokens=False)
    sides = [[(i, bytes(byte_of[c] for c in t)) for i, t in zip(found.ids, found.tokens)],
             [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]]
    if any(b"".join(t for _, t in side) != (" " + text).encode() for side in sides):
        return [], []
    out = []
    for side in sides:
        at, spans = 0, []
        for i, t in side:
            spans.append((i, at, at + len(t)))
            at += len(t)
        out.append(spans)
    return tuple(out)


def expected(libraries, texts):
    links, groups = [], []
    for text in texts:
        a, b = tokens(libraries, text)
        links.append([(i, j) for i, s, e in a for j, t, f in b if s < f and t < e])
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups.append(";".join(",".join(str(i) for i, s, e in a if lo <= s and e <= hi) + "|" + ",".join(str(i) for i, s, e in b if lo <= s and e <= hi) for lo, hi in zip([0, *ends], ends)))
    count = defaultdict(int)
    for some in links:
        for pair in set(some):
            count[pair] += 1
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    rows = []
    for text, some, g in zip(texts, links, groups):
        a, b = tokens(libraries, text)
        rows.append((len(a), len(b), len(g.split(";")) if g else 0, len(some), sum(count[p] == top[p[0]] for p in some), sum(count[p] for p in some),
                     hashlib.sha256(g.encode()).hexdigest() if g else ""))
    return rows, {(*p, n, n == top[p[0]]) for p, n in count.items()}


def texts():
    rng = random.Random(7)
    odd = ["", None, " ", "  ", "a", " a", "a ", "  a  b ", "a  b\n\n c\t", "<|endoftext|> x", "x ▁ y", "▁", "<s>a</s>", "<0x0A>", "é e\u0301 ﬁ", "日本語 中文 テスト", "🎉 🎉🎉", "\0 x", "don't",
           "\u3000wide", "x" * 500, "a\u00a0b", "naïve café", "1234567 and 89", "tab\tand\r\nline", "word " * 30, "the the the", "the"]
    return odd + ["".join(rng.choice("the an ing.  é日\n'0") for _ in range(rng.randrange(120))) for _ in range(150)]


def test_piece_encoder_is_the_library(libraries):
    encoder = alignment.PieceEncoder(B)
    for t in texts():
        if t:
            assert list(memoryview(encoder.encode(t)).cast("I")) == libraries[1].encode(t), t


@pytest.mark.parametrize("block_bytes", [4_000_000, 200])
def test_odd_texts(spark, libraries, block_bytes):
    some = texts() + ["the the the", "the", "the", "a"]
    rows = [(i if i % 9 else None, t, "own", 3) for i, t in enumerate(some)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_a string, id int").repartition(5)
    out, pairs = alignment.align_tokenizers(df, A, P.PATTERN, B, keep_groups=True, block_bytes=block_bytes)
    want, counted = expected(libraries, some)
    got = out.collect()
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=str)
    assert {tuple(r) for r in pairs.collect()} == counted
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["groups"])
    assert sum(r["n_a"] == 0 for r in got) >= 4  # null, empty and two with the sign that stands for a space


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    out, pairs = alignment.align_tokenizers(df, A, P.PATTERN, B)
    assert out.collect() == [] and pairs.collect() == [] and out.columns == ["doc_id", *NAMES]
    out, _ = alignment.align_tokenizers(spark.createDataFrame([(1, None), (1, "")], df.schema), A, P.PATTERN, B)
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_whole_table(spark, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 4000).select("doc_id", "text").collect()]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    out, _ = alignment.align_tokenizers(df, A, P.PATTERN, B)
    want, _ = expected(libraries, [t for _, t in docs])
    assert sorted(map(tuple, out.collect())) == sorted((d, *w) for (d, _), w in zip(docs, want))
    assert queries.op13_tokenizer_alignment(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_a_block_is_aligned_in_steps():
    """Work arrays are those of a step, not of a block, and the block's pairs, links and groups are the same."""
    import numpy as np
    import public_tokenizers

    from runquarry.llm.alignment import Aligner, align_in_steps

    aligner = Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    texts = [f"Some text {i} about the same words, über {i % 7} things." * (1 + i % 3) for i in range(200)]
    sizes = []

    class Recorder:
        def align(self, some):
            sizes.append(sum(map(len, some)))
            return aligner.align(some)

    whole, steps = aligner.align(texts), align_in_steps(Recorder(), texts, 1000)
    assert len(sizes) > 10 and max(sizes) <= 1000
    assert whole.keys() == steps.keys() and whole["groups"] is not None
    for name in whole:
        if name == "groups":
            assert [bytes(g) for g in whole[name]] == [bytes(g) for g in steps[name]]
        else:
            assert np.array_equal(whole[name], steps[name]), name
    assert align_in_steps(aligner, texts, 10**9)["n_links"].sum() == whole["n_links"].sum()
