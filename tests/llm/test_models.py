import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import ann, langid, toxicity


def test_sums_are_carried_over_any_length(monkeypatch):
    """A run that is cut nowhere equals the plain sum over places, however it is processed."""
    monkeypatch.setattr(langid, "BLOCK", 100)
    pieces = langid.pieces_of(langid.default_path())
    rng = np.random.default_rng(5)
    p = np.vstack([rng.dirichlet(np.full(len(pieces), 0.3), size=2).T, np.zeros(2)])
    for text in ("internationalinformation" * 3, "日本語の文字列" * 18, "straßenbahn" * 500, "ab" * 4000):
        t, begin, end, _ = langid.stretches([text])
        assert list(end - begin) == [len(text.encode())]
        alone = langid._one_long(pieces, p, t, int(begin[0]), int(end[0]))
        assert np.allclose(alone, langid.log_probabilities(pieces, p, t, begin, end)[0])
        data, sums = text.encode()[:380], [np.ones(2)]
        for j in range(1, len(data) + 1):
            numbers = [pieces.find(langid._hashes([data[j - k : j]]) ^ (langid._FIRST if j == k else np.uint64(0)))[0] for k in range(1, min(pieces.longest, j) + 1)]
            sums.append(sum(sums[-k] * p[n] for k, n in enumerate(numbers, 1)))
            if sums[-1].max() < 1e-250:
                break
        t, begin, end, _ = langid.stretches([data[: len(sums) - 1].decode("utf-8", "ignore")])
        plain = np.log(sums[int(end[0] - begin[0])])
        assert np.allclose(langid._one_long(pieces, p, t, int(begin[0]), int(end[0])), plain) and np.allclose(langid.log_probabilities(pieces, p, t, begin, end)[0], plain)
    t, begin, end, doc = langid.stretches(["日本語の文字列" * 40, "ab"], 64)
    assert (end - begin).max() <= 64 and all(t.buf[a:b].tobytes().decode() for a, b in zip(begin, end)) and list(np.bincount(doc)) == [len(end) - 1, 1]


def test_forward_sums_all_segmentations():
    pieces = langid.pieces_of(langid.default_path())
    p = np.random.default_rng(1).random((len(pieces) + 1, 2))
    p[-1] = 0
    p /= p.sum(axis=0)
    words = ["the", "éa", "ingthe", "x", "straße", "a" * 64]
    t, begin, end, _ = langid.stretches(words)
    got = langid.log_probabilities(pieces, p, t, begin, end)

    def number(data, first):
        return pieces.find(langid._hashes([data]) ^ (langid._FIRST if first else np.uint64(0)))[0]

    def all_cuts(data, first=True):
        if not data:
            return np.ones(2)
        return sum(p[number(data[:k], first)] * all_cuts(data[k:], False) for k in range(1, min(pieces.longest, len(data)) + 1))

    for k, w in enumerate(words[:5]):
        assert np.allclose(got[k], np.log(all_cuts(w.encode())))
    assert np.isfinite(got).all()
    counts = langid.expected_counts(pieces, p, t, begin, end, np.ones((len(words), 2)))
    assert (counts >= 0).all() and counts[:, 0].sum() > 0


def test_expected_counts_cover_the_text():
    pieces = langid.pieces_of(langid.default_path())
    p = np.full((len(pieces) + 1, 1), 1 / len(pieces))
    p[-1] = 0
    t, begin, end, _ = langid.stretches(["x", "qj"])
    counts = langid.expected_counts(pieces, p, t, begin, end, np.ones((2, 1)))
    assert np.isclose(counts.sum(), 3)  # "x" is one piece, "qj" none, so two letters


def test_language_of_held_out_rows(spark, small):
    docs = small("documents")
    got = langid.identify(docs)
    both = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert both.count() == docs.where("crc32(cast(doc_id as string)) % 5 = 0").count()
    assert both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
    blind = langid.identify(docs.withColumn("lang", F.when(~langid.held_out(F.col("doc_id")), F.col("lang"))))
    assert sorted(map(tuple, blind.collect())) == sorted(map(tuple, got.collect()))  # held-out labels change nothing


def test_joins_by_exchange_teach_the_same(spark, small, monkeypatch):
    docs = small("documents").withColumns({"rank": F.lit(1), "n": F.lit("x"), "score": F.lit(2.0)})
    want = sorted(map(tuple, langid.identify(docs).collect()))
    monkeypatch.setattr(langid, "MOST_BROADCAST", 1)
    assert sorted(map(tuple, langid.identify(docs).collect())) == want


def test_language_cases(spark, docs_of):
    docs = docs_of((0, "der die das und", "de", "s"), (1, "the and of that", "en", "s"), (2, None, "en", "s"), (3, "12 34 !", "en", "s"), (4, "", None, None), (None, "the", "en", "s"), (6, "that the " * 40_000, "en", "s"), (8, "x" * 100_000, "en", "s")).withColumn("word", F.lit(1))
    got = {r["doc_id"]: r for r in langid.identify(docs.unionByName(docs.where("doc_id = 1"))).collect()}
    assert [got[k]["lang_pred"] for k in (2, 3, 4)] == ["und"] * 3 and got[2]["score"] == 0 and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[6]["lang_pred"] == "en"
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert langid.identify(docs.limit(0)).count() == 0


def test_toxicity_of_held_out_rows(spark, small):
    docs, labels = small("documents"), small("labels")
    got = toxicity.score(docs, labels)
    both = got.join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = both[both["toxic"] == 1], both[both["toxic"] == 0]
    wins = (toxic["score"].to_numpy()[:, None] > clean["score"].to_numpy()).mean() + (toxic["score"].to_numpy()[:, None] == clean["score"].to_numpy()).mean() / 2
    assert wins >= 0.8 and clean["predicted"].mean() <= 0.02
    hidden = toxicity.score(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    assert sorted(map(tuple, hidden.collect())) == sorted(map(tuple, got.collect()))


def test_toxicity_cases(spark, docs_of, small):
    docs = docs_of(None, "", "fine", (None, "bad"), "bad " * 50_000).withColumn("toxic", F.lit("clash"))
    for labels in (small("labels").limit(0), small("labels").where("toxic = 0"), spark.createDataFrame([(0, 1, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")):
        got = toxicity.score(docs.unionByName(docs.where("doc_id = 2")), labels).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert toxicity.score(docs.limit(0), small("labels")).count() == 0


def test_positive_unlabelled_learning():
    rng = np.random.default_rng(2)
    text = lambda toxic: np.unique(np.concatenate([rng.integers(100, 400, 30), [7] if toxic else []]).astype(np.int64))
    positive = [text(True) for _ in range(150)]
    unlabelled = [text(rng.random() < 0.1) for _ in range(600)]
    model = toxicity.PositiveUnlabelled.of(positive, unlabelled, 0.1)
    tests = [text(k % 2 == 0) for k in range(100)]
    margins = model.margin(np.concatenate(tests).astype(np.uint64), np.repeat(np.arange(100), [len(t) for t in tests]), 100)
    assert margins[::2].min() > margins[1::2].max()
    scores = model.calibrate(margins, np.arange(100) % 2 == 0).score(margins)
    assert scores[::2].min() > 0.9 and scores[1::2].max() < 0.1


def plain_risk(w, b, positive, unlabelled, prior):
    loss = lambda z: float(np.logaddexp(0, z))
    margin = lambda s: sum(w[k] for k in s) + b
    towards = sum(loss(-margin(s)) for s in positive) / len(positive)
    negative = sum(loss(margin(s)) for s in unlabelled) / len(unlabelled) - prior * sum(loss(margin(s)) for s in positive) / len(positive)
    return prior * towards, negative


def test_descent_follows_the_plain_risk():
    """The gradient is that of the risk written out row by row; the risk falls while its negative part is not below zero."""
    rng = np.random.default_rng(3)
    draw = lambda n, p: [np.flatnonzero(rng.random(12) < p) for _ in range(n)]
    positive, unlabelled = draw(40, np.r_[np.full(3, 0.6), np.full(9, 0.1)]), draw(300, np.full(12, 0.12))
    w, b, prior = rng.random(12), -0.5, 0.1
    sp, counts = toxicity.Sets(positive), {}
    for s in unlabelled:
        counts[tuple(s)] = counts.get(tuple(s), 0) + 1
    su = toxicity.Sets(list(counts), np.array(list(counts.values()), float))  # equal sets once, with their number
    g = sp.back(-prior * sp.weight, 12) + su.back(su.weight * toxicity._sigmoid(su.margins(w, b)), 12)  # of both parts together
    whole = lambda w, b: sum(plain_risk(w, b, positive, unlabelled, prior))
    for k in range(12):
        e = np.eye(12)[k] * 1e-6
        assert np.isclose((whole(w + e, b) - whole(w - e, b)) / 2e-6, g[k], atol=1e-6)
    after = toxicity.descend(w, b, sp, su, prior, 100)
    assert whole(*after) < whole(w, b) and (after[0] >= 0).all() and after[0][:3].mean() > after[0][3:].mean()


def test_groups_of_unlabelled_texts_teach_as_one(spark, small, monkeypatch):
    docs, labels = small("documents"), small("labels")
    one = toxicity.score(docs, labels).toPandas().sort_values("doc_id")
    monkeypatch.setattr(toxicity, "GROUP_TEXTS", 200)
    several = toxicity.score(docs, labels).toPandas().sort_values("doc_id")
    assert (one["predicted"].to_numpy() == several["predicted"].to_numpy()).mean() > 0.97


def brute(ids, vectors, every, nearest):
    ok = np.array([v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors])
    out = {}
    for q in [k for k in range(len(ids)) if ok[k] and ids[k] % every == 0]:
        scored = [(-float(np.dot(vectors[q], vectors[k]) / np.sqrt(np.dot(vectors[q], vectors[q])) / np.sqrt(np.dot(vectors[k], vectors[k]))), ids[k]) for k in range(len(ids)) if ok[k] and ids[k] != ids[q] and len(vectors[k]) == len(vectors[q])]
        out[ids[q]] = sorted((round(s, 12), i) for s, i in scored)[:nearest]
    return out


@pytest.mark.parametrize("n", [0, 1, 4, 700])
def test_neighbours(spark, n, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 200)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 10)
    rng = np.random.default_rng(n)
    rows = [(k, [float(x) for x in rng.normal(size=16)], 0) for k in range(n)]
    if n > 4:
        rows += [(n + k, list(rows[3][1]), 0) for k in range(40)] + [(2000, None, 0), (2050, [0.0] * 16, 0), (2100, [float("nan")] * 16, 0), (2150, [None] * 16, 0), (2200, [1.0] * 8, 0), (None, [1.0] * 16, 0), rows[50], (2250, [], 0)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit(9))).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], round(-r["score"], 12), r["vec_id"]))
    seen = [r for r in rows if r[0] is not None]
    want = brute([r[0] for r in seen], [r[1] for r in seen], 50, 5)
    found = total = 0
    for q, near in want.items():
        near = list(dict.fromkeys(near))
        mine = sorted(got.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(near) + 1)) or len(near) < 5
        found += len({i for _, i in near} & {i for _, _, i in mine})
        total += len(near)
    assert found >= 0.9 * total


def test_probing_finds_the_whole_ball():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**63, (300, ann.WORDS)).astype(np.uint64)
    codes[150:] = codes[:150] ^ np.packbits(rng.random((150, ann.BITS)) < 0.06, axis=1).view(np.uint64)
    for vectors, radius in ((300, 0), (300, 20), (10**5, 40), (10**9, 11), (10**9, 24)):
        split = ann.Substrings(vectors, radius)
        masks, values = split.masks(), split.values(codes)
        assert split.probes == sum(map(len, masks)) and sum(split.radii) + len(split.radii) > radius and split.edges[-1] == ann.BITS
        found = np.zeros((20, 300), bool)
        for v, m in zip(values, masks, strict=True):
            found |= (v[:20, None, None] ^ m[None, :, None] == v[None, None, :]).any(axis=1) if len(m) < 2000 else np.bitwise_count(v[:20, None] ^ v[None, :]) <= max(np.bitwise_count(m))
        ball = np.stack([ann.distance(codes, q) <= radius for q in codes[:20]])
        assert not (ball & ~found).any()


def clustered(n, seed=6, width=24, near=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), width))
    return centres[rng.integers(len(centres), size=n)] + near * rng.normal(size=(n, width))


def test_probes_and_blocks_find_the_same(spark, monkeypatch):
    """On clustered vectors the index is probed; a bucket over the limit is salted; outliers are searched in full."""
    x = np.vstack([clustered(900), clustered(300, 7, near=1e-4)[:1] + 1e-4 * np.random.default_rng(8).normal(size=(300, 24)), np.random.default_rng(9).normal(size=(30, 24))])
    table = spark.createDataFrame([(k * 5, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = lambda df: sorted(map(tuple, df.collect()))
    monkeypatch.setattr(ann, "PROBE_COST", 1e9)
    blocks = rows(ann.search(table))
    monkeypatch.setattr(ann, "PROBE_COST", 0)
    monkeypatch.setattr(ann, "BUCKET_VECTORS", 64)
    probed = rows(ann.search(table))
    want = brute([5 * k for k in range(len(x))], [list(v) for v in x], 50, 5)
    for found in (blocks, probed):
        near = {q: {r[2] for r in found if r[0] == q} for q in want}
        assert all(len(v) == 5 for v in near.values())
        assert sum(len(near[q] & {i for _, i in w}) for q, w in want.items()) >= 0.9 * 5 * len(want)
    assert len(set(blocks) & set(probed)) >= 0.95 * len(blocks)


@pytest.mark.parametrize("spread", [0.02, 1.0, 30.0])
def test_a_shard_probes_its_tables_for_the_whole_ball(spread):
    """The ball is that of all codes compared; what is not in a probed bucket is never looked at."""
    x = clustered(1500, near=spread)
    model = ann.RotatedCodes().fit(x / np.linalg.norm(x, axis=1, keepdims=True))
    codes = model.encode(x / np.linalg.norm(x, axis=1, keepdims=True))
    packed = [v.astype("<f8").tobytes() for v in x]
    for radius in (0, 9, 60, 108):
        shard = ann.Shard([[k] for k in range(1500)], packed, [c.tobytes() for c in codes], radius, 5)
        assert sorted(shard.order[0].tolist()) == list(range(1500)) and shard.starts[0][-1] == 1500
        for k in range(0, 1500, 50):
            values = [v[0] for v in shard.split.values(codes[k : k + 1])]
            assert shard.ball(codes[k], values).tolist() == np.flatnonzero(ann.distance(codes, codes[k]) <= radius).tolist()
    unsearched = ann.Shard([[k] for k in range(1500)], packed, [c.tobytes() for c in codes], 9, 5)
    unsearched.masks = [m[:0] for m in unsearched.masks]
    assert not len(unsearched.ball(codes[0], [v[0] for v in unsearched.split.values(codes[:1])]))


def test_evenly_spread_vectors_go_through_shards(spark, monkeypatch):
    """Without clusters the index lies by shard; recall is that of the radius, ranks and scores are those of brute force."""
    x = np.random.default_rng(2).normal(size=(3000, 32))
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 1000)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(ann, "_by_value", None)  # is never called
    table = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((round(-r["score"], 12), r["vec_id"]))
    want = brute(list(range(3000)), [list(v) for v in x], 50, 5)
    assert set(got) == set(want) and all(len(v) == 5 and v == sorted(v) for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 5 * len(want)


def test_little_of_clustered_data_is_probed(spark):
    """The radius is that of true neighbours among all vectors, and few codes are within the probes."""
    x = clustered(4000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = ann.RotatedCodes().fit(x[:500])
    codes, packed = model.encode(x), [v.tobytes() for v in x]
    entries = spark.createDataFrame([(v, c.tobytes()) for v, c in zip(packed, codes)], "vec binary, code binary").repartition(5)
    radius = ann._radii(entries, {24 * 8: model}, {24 * 8: packed[:200]}, 5)[24 * 8]
    near = np.argsort(-(x[:200] @ x.T), axis=1)[:, 1:6]
    apart = np.stack([ann.distance(codes[:200], codes[near[:, k]]) for k in range(5)])
    assert radius == int(np.quantile(apart, ann.COVERED))
    split = ann.Substrings(10**6, radius)
    hit = np.zeros((100, len(x)), bool)
    for v, most in zip(split.values(codes), split.radii, strict=True):
        hit |= np.bitwise_count(v[:100, None] ^ v[None, :]) <= most
    assert hit.mean() < 0.05


def test_any_finite_size_and_repeated_ids(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [1.0, 0.0]), (3, [1e-200, 1e-200]), (4, [5e-324, 0.0]), (50, [0.0, 1.0]), (50, [1.0, 0.1]), (7, [0.0, 3.0]), (7, [1.0, 0.1])]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    assert got[0] == [(2, 1.0), (4, 1.0), (1, round(1 / 1.01**0.5, 9)), (7, round(1 / 1.01**0.5, 9)), (50, round(1 / 1.01**0.5, 9))] or got[0][:2] == [(2, 1.0), (4, 1.0)]
    assert {i for i, _ in got[0]} == {1, 2, 4, 7, 50} and got[50][0] == (7, 1.0) and len({i for i, _ in got[50]}) == 5


def test_vectors_of_lengths_the_sample_lacks_are_searched(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_VECTORS", 20)
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 100)
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=16 if k % 50 > 1 or k < 100 else 4 + k // 200)]) for k in range(600)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q, vec in rows[::50]:
        if len(vec) < 16:
            unit = lambda v: np.array(v) / np.linalg.norm(v)
            want = sorted((i for i, v in rows if i != q and len(v) == len(vec)), key=lambda i: -unit(rows[i][1]) @ unit(vec))[:5]
            assert [got[q][k] for k in sorted(got[q])] == want
    assert set(got) == {q for q, _ in rows[::50]}
