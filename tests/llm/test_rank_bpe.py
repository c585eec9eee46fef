"""Word-by-word BPE against the tokenizers library."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runquarry.llm import queries, rank_bpe

PATH = P.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encode():
    return rank_bpe.word_encoder(PATH, P.PATTERN)[0]


def numbers(raw):
    return np.frombuffer(raw, "<u4").tolist()


def odd_texts():
    rng = random.Random(1)
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    return ["", " ", "\n", "a", "x" * 3000, letters(3000, "abcdefghij"), letters(900, "日本語中文"), "é" * 500, "\0" * 10, "a" * 199 + " " + "b" * 201, "!" * 999,
            "  a  b\n\n c \t", " lead", "trail ", "don't I'll WE'RE 'S", "1234567 89", "\u2028\u3000x\xa0y", "🎉🎉 e\u0301",
            "<|endoftext|>", "a<|endoftext|>b <|endoftext|> <|endoftext|", "<|endoftext|><|endoftext|>", *[letters(rng.randrange(400), "ab \n'1.é日<|>") for _ in range(300)]]


def test_ids_are_the_library_s(encode, library):
    for text in odd_texts():
        assert numbers(encode(text)) == library.encode(text, add_special_tokens=False).ids, text[:60]


def test_scan_and_heap_agree():
    merger, rng = rank_bpe.WordMerger(PATH), random.Random(3)
    for n in [*range(0, 40), 199, 200, 400]:
        word = "".join(rng.choice("aeinrst hé") for _ in range(n)).encode()
        merger.long = 1 << 30
        scanned = merger.merge(word)
        merger.long = -1
        assert merger.merge(word) == scanned


def test_plain_text_instead_of_special_tokens(library):
    encode, merger = rank_bpe.word_encoder(PATH, P.PATTERN, special=False)
    other = Tokenizer.from_file(PATH)
    other.encode_special_tokens = True
    for text in odd_texts():
        assert numbers(encode(text)) == other.encode(text, add_special_tokens=False).ids


def test_little_memory_changes_nothing(library):
    encode, _ = rank_bpe.word_encoder(PATH, P.PATTERN, most=3000, longest=5)
    for text in odd_texts():
        assert numbers(encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_a_megabyte_without_a_space(encode):
    start = time.time()
    assert len(encode("".join(random.Random(5).choice("abcdefghijklmnop") for _ in range(1_000_000)))) > 1_000_000
    assert time.time() - start < 60


def test_rows(spark, library):
    texts = odd_texts() + [None]
    rows = [(i if i % 7 else None, t, "own", 1) for i, t in enumerate(texts)] + [(1, "again", "own", 1), (1, "again", "own", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, ids int")
    got = sorted(map(tuple, rank_bpe.encode_words(df, PATH, P.PATTERN).collect()), key=str)
    want = []
    for key, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False) if ids else ""
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    kept = rank_bpe.encode_words(df.where("text is not null"), PATH, P.PATTERN, keep_ids=True)
    assert kept.where(F.size("ids") != F.col("n_tokens")).isEmpty()
    assert sorted(r["decoded"] for r in kept.collect()) == sorted(t for _, t, *_ in rows if t is not None)
    assert rank_bpe.encode_words(df.limit(0), PATH, P.PATTERN).collect() == []


def test_decoding_cuts_characters_like_the_library(library):
    merger = rank_bpe.WordMerger(PATH)
    for ids in ([merger.bytes[0xC3]], [merger.bytes[0xE6], merger.bytes[0x97], merger.bytes[65]], [merger.bytes[0xF0], merger.bytes[0x9F], 50256, merger.bytes[0xFF]]):
        plain = b"".join(merger.token_bytes[i] for i in ids).decode("utf-8", errors="replace")
        assert plain == library.decode(ids, skip_special_tokens=False)


def test_whole_table(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_rank_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()
