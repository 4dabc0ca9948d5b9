import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from rillflow.llm import twotier


@pytest.fixture(scope="module")
def ours():
    return twotier.TwoTier(twotier.default_path())


@pytest.fixture(scope="module")
def library(ours):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


HARD = [
    "", None, "a" * 3000, " \n\t " * 50 + "x", "   ", "it's we'll DON'T 's's 'stuff 're 'r 'v 'lle 'L ''s '", "'", "a'", "'s", " 's", "\n's", "\n 's", "'ll'", "'re're", "l'l", "''ll", "'m1", "x'd.y",
    "<|endoftext|> x", "\x1c\x1d\x85 a\xa0b​﻿c", "՘Ᲊ 1²½Ⅷ٣　x", "日本語" * 100, "🙂👍🏽 👩‍👩‍👧", "\x00\x7f", "a  b", "a \n b", "  a", "a  ", " \xa0a", "\xa0 a", "𞤀𞥐 𐓀\U0010ffff é",
]


def test_the_rule_is_the_vocabulary_s():
    assert twotier.PATTERN == public_tokenizers.PATTERN


def test_ids_and_bytes_equal_the_library(corpus, library, ours):
    rng = random.Random(1)
    texts = [t for _, t, _, _ in corpus] + HARD
    texts += ["".join(rng.choice("abe th\n\t 'sétrvmdl1² ́ß字🙂.<|>\xa0") for _ in range(rng.randrange(200))) for _ in range(2000)]
    texts += ["".join(rng.choice(" 'srelvtmd\n") for _ in range(rng.randrange(12))) for _ in range(5000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x10000, 0x20000), 32])) for _ in range(60)) for _ in range(500)]
    ids, sizes = ours.encode(texts)
    assert len(sizes) == len(texts)
    for text, mine in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert mine.tolist() == library.encode_ordinary(text or "")
        assert ours.decode(mine) == (text or "").encode()


def test_other_rules_are_run_as_they_are(ours, corpus):
    rule = r"\p{L}+|[0-9]"  # leaves characters out
    encoder, library = twotier.TwoTier(twotier.default_path(), rule), tiktoken.Encoding("other", pat_str=rule, mergeable_ranks=ours.ranks, special_tokens={})
    texts = [t for _, t, _, _ in corpus[:50]] + ["", None, "é1 字22", "..."]
    ids, sizes = encoder.encode(texts)
    for text, mine in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert mine.tolist() == library.encode_ordinary(text or "")


def test_classes_are_those_of_unicode_where_versions_agree():
    kind = twotier.classes()
    for c in "aZé字1²٣ \n\xa0\x1f.🙂_":
        want = twotier.LETTER if regex.match(r"\p{L}", c) else twotier.DIGIT if regex.match(r"\p{N}", c) else twotier.SPACE if regex.match(r"\s", c) and c != "\x1f" else twotier.OTHER
        assert kind[ord(c)] == want, c


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 20_000])
def test_the_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    if n:
        assert sorted(twotier.PerfectHash(keys).places(keys).tolist()) == list(range(len(keys)))
    else:
        twotier.PerfectHash(keys)


def test_a_place_is_no_proof(ours):
    """Pieces that aren't in the vocabulary get a place too; lengths and bytes decide."""
    strange = [f"zq{k}xj" for k in range(500)]
    ids, sizes = ours.encode(strange)
    assert (sizes > 1).all() and ours.decode(ids) == "".join(strange).encode()


def test_merging_takes_the_leftmost_lowest(ours):
    def plain(piece):
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while True:
            ranks = [(ours.ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ours.ranks]
            if not ranks:
                return [ours.ranks[p] for p in parts]
            k = min(ranks)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng = random.Random(2)
    for _ in range(400):
        piece = bytes(rng.choice(b"the ringsatoa\xc3\xa9  ") for _ in range(rng.randrange(1, 80)))
        assert ours.merge(piece) == plain(piece)
    for width in (2, 4, 16, 64):
        pieces = [bytes(rng.choice(b"the ringsatoa\xc3\xa9  ") for _ in range(rng.randrange(1, width + 1))) for _ in range(300)]
        ids, many = ours.merge_rows(pieces, width)
        assert [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])] == [plain(p) for p in pieces]
    assert ours.merge(b"x1" * 2000) == plain(b"x1" * 2000)
    assert ours.decode(np.array(ours.merge(b"ab" * 50_000))) == b"ab" * 50_000


def test_heaps_give_the_least_of_each_row():
    rng = np.random.default_rng(3)
    rows = np.where(rng.random((50, 8)) < 0.6, rng.integers(0, 100, (50, 8)), twotier.NONE)
    heaps, lists = twotier.Heaps(rows), [sorted(x for x in r if x < twotier.NONE) for r in rows.tolist()]
    for _ in range(40):
        put = np.flatnonzero((rng.random(50) < 0.5) & (heaps.count < 16))
        values = rng.integers(0, 100, len(put))
        heaps.push(put, values)
        for r, x in zip(put.tolist(), values.tolist(), strict=True):
            lists[r] = sorted([*lists[r], x])
        take = np.flatnonzero((rng.random(50) < 0.5) & (heaps.count > 0))
        assert heaps.pop(take).tolist() == [lists[r].pop(0) for r in take.tolist()]
        assert heaps.count.tolist() == list(map(len, lists))


def test_cache_limit_changes_nothing(ours, corpus, monkeypatch):
    texts = [t for _, t, _, _ in corpus[:50]]
    want = ours.encode(texts)[0]
    for limit in ("CACHE_PIECES", "CACHE_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(twotier, limit, 10)
            assert (ours.encode(texts)[0] == want).all() and (ours.encode(texts)[0] == want).all()


def test_cases(spark, docs_of, library):
    docs = docs_of(None, "", "héllo", (None, "x"), "word" * 50_000, "a b").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    docs = docs.unionByName(docs.where("doc_id = 2"))
    rows = twotier.encoded_digests(docs).collect()
    assert len(rows) == 7 and sum(r["doc_id"] is None for r in rows) == 1
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["n_tokens"] == by_id[1]["n_tokens"] == 0 and by_id[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest() == by_id[1]["decoded_sha256"]
    ids = library.encode_ordinary("héllo")
    assert by_id[2]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and by_id[2]["decoded_sha256"] == hashlib.sha256("héllo".encode()).hexdigest()
    encoded = twotier.encode(docs)
    back = {r["doc_id"]: bytes(r["content"]) for r in twotier.decode(encoded).collect()}
    assert back[2] == "héllo".encode() and back[0] == b"" and back[4] == b"word" * 50_000
    assert twotier.encoded_digests(docs.limit(0)).count() == 0 and twotier.decode(twotier.encode(docs.limit(0))).count() == 0


def test_query_equals_the_library_row_by_row(spark, corpus, library):
    from rillflow.llm import queries

    found = {r["doc_id"]: r for r in queries.op11_bpe_two_tier(spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == len(corpus)
    for doc_id, text, _, _ in corpus:
        ids = library.encode_ordinary(text or "")
        want = (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest())
        assert tuple(found[doc_id]) == want
