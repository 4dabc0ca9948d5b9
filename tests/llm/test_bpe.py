import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillflow.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def ours():
    return bpe.ByteBpe(bpe.default_path())


def test_ids_and_texts_equal_the_library(corpus, library, ours):
    rng = random.Random(1)
    texts = [t for _, t, _, _ in corpus]
    texts += ["", None, "<|endoftext|>", " <|endoftext|>  x <|endoftext|><|endoftext|>", "a" * 3000, " \n\t " * 50 + "x", "   ", "՘Ᲊ 1²½Ⅷ٣　x", "it's we'll DON'T 's's", "\x1c\x1d\x85 a\xa0b​﻿c", "日本語" * 100, "🙂👍🏽 👩‍👩‍👧", "\x00\x7f"]
    texts += ["".join(rng.choice("abe th\n\t 'sé1² ́ß字🙂.<|>") for _ in range(rng.randrange(200))) for _ in range(300)]
    ids, sizes = ours.encode(texts)
    for text, mine in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert mine.tolist() == want
        assert ours.decode(mine).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_both_trees_agree_and_the_root_is_leftmost_lowest(ours):
    def plain(data):
        ids = [int(ours.byte_ids[b]) for b in data]
        while True:
            ranks = [(ours.pair[a << 32 | b], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in ours.pair]
            if not ranks:
                return ids
            rank, k = min(ranks)
            ids[k : k + 2] = [int(ours.made[rank])]

    rng = random.Random(2)
    for _ in range(200):
        data = bytes(rng.choice(b"the ringsatoa\xc3\xa9") for _ in range(rng.randrange(1, 65)))
        width = 1 << (len(data) - 1).bit_length()
        row = np.full((1, width), -1, np.int64)
        row[0, : len(data)] = ours.byte_ids[np.frombuffer(data, np.uint8)]
        merged = ours.merge_rows(row)[0]
        assert merged[merged >= 0].tolist() == ours.merge_one(data) == plain(data)


def test_cache_limit_changes_nothing(ours, corpus, monkeypatch):
    texts = [t for _, t, _, _ in corpus[:50]]
    want = ours.encode(texts)[0]
    for limit in ("CACHE_PIECES", "CACHE_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(bpe, limit, 10)
            assert (ours.encode(texts)[0] == want).all() and (ours.encode(texts)[0] == want).all()


def test_cases(spark, docs_of, library):
    docs = docs_of(None, "", "héllo", (None, "x"), "word" * 50_000, "a b").withColumn("ids", F.lit("clash"))
    docs = docs.unionByName(docs.where("doc_id = 2"))
    encoded = bpe.encode(docs)
    rows = {r["doc_id"]: r for r in bpe.digests(encoded).collect()}
    assert encoded.count() == 7 and rows[0]["n_tokens"] == 0 and rows[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    ids = library.encode("héllo", add_special_tokens=False).ids
    assert rows[2]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and rows[2]["decoded_sha256"] == hashlib.sha256("héllo".encode()).hexdigest()
    assert sorted(map(str, bpe.encoded_digests(docs).collect())) == sorted(map(str, bpe.digests(encoded).collect())) and bpe.encoded_digests(docs.limit(0)).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()}
    assert back[2] == "héllo" and back[0] == "" and back[4] == "word" * 50_000
    assert bpe.digests(bpe.encode(docs.limit(0))).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, [50_000, 161])], "doc_id long, ids array<int>")).count() == 1
