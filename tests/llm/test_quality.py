import re

import numpy as np
from pyspark.sql import functions as F

from rillflow.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    counts = {x: windows.count(x) for x in set(windows)} if len(windows) < 3000 else {}
    covered = {i + k for i, x in enumerate(windows) if counts.get(x, 0) > 1 for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_equal_brute_force(corpus):
    texts = [t for _, t, _, _ in corpus if len(t) < 12_000] + [None, "", "\n\n", "a\na\n a\nb\x0bc\na", "é\x0c# *", "\r\n\r\n", "x y z u v w a b " * 3, "日本 語\n日本 語"]
    counts, features = quality.statistics(texts)
    got = list(zip(*(counts[c].tolist() for c in quality.COUNTS), strict=True))
    assert got == [brute(t) for t in texts]
    assert np.isfinite(features).all() and ((features >= 0) & (features <= 1)).all()


def test_held_out_junk_goes_and_clean_texts_stay(spark, small):
    docs, labels = small("documents"), small("labels")
    judged = quality.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    share = {r["quality"]: r["kept"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] >= 0.98 and share.get(0, 0) <= 0.2


def test_cases(spark, docs_of, small):
    labels = small("labels")
    docs = docs_of(None, "", "one", "word " * 50_000, (None, "x " * 30), (7, "a b c d e f g h i j k l m n o p q r s t u v")).withColumn("n_words", F.lit("clash"))
    docs = docs.unionByName(docs.where("doc_id = 7"))
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality.judge(docs, known)
        assert got.count() == 7 and got.where("doc_id = 7").distinct().count() == 1
        assert got.where("doc_id < 4 and not base_failed").count() == 0
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 2 and kept.first()["n_words"] == "clash"
    assert quality.judge(docs.limit(0), labels).count() == 0
    bad = labels.withColumn("quality", F.lit(None).cast("int")).unionByName(labels.withColumn("doc_id", F.lit(None).cast("long")))
    assert quality.train(docs, bad) is None


def test_forest_and_threshold():
    rng = np.random.default_rng(0)
    good, odd = rng.normal(0.3, 0.02, (500, 3)).clip(0, 1), rng.uniform(0.7, 1, (40, 3))
    forest = quality.IsolationForest().fit(good, np.vstack([good, odd]))
    scores = forest.score(np.vstack([good, odd]))
    assert scores[:500].max() < scores[500:].min()
    threshold = quality.calibrate(scores, np.arange(540) < 500)
    assert scores[:500].max() < threshold <= scores[500:].min()
    assert quality.calibrate(np.array([0.5, 0.5]), np.array([True, False])) == float("inf")  # a tie rejects nobody


def test_scores_for_the_threshold_are_of_forests_without_the_row():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0.3, 0.02, (400, 4)), rng.normal(0.8, 0.02, (60, 4))]).clip(0, 1)
    order = rng.permutation(len(x))
    x, good = x[order], (np.arange(len(x)) < 400)[order]
    scores = quality.held_out(x, good)
    own = quality.IsolationForest().fit(x[good & (np.arange(len(x)) % 4 != 1)], x[np.arange(len(x)) % 4 != 1]).score(x[np.arange(len(x)) % 4 == 1])
    assert (scores[np.arange(len(x)) % 4 == 1] == own).all()
    limit = quality.calibrate(scores, good)
    assert (scores[~good] >= limit).mean() > 0.95 and (scores[good] >= limit).mean() <= quality.MOST_GOOD_REJECTED
    assert len(quality.held_out(x[:3], np.array([True, False, False]))) == 3


def test_every_labelled_row_counts(spark, monkeypatch):
    monkeypatch.setattr(quality, "TREES", 16)
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(0.3, 0.05, (18_000, 4)), rng.normal(0.6, 0.1, (2_000, 4))]).clip(0.01, 0.99)
    x[17, 0], x[18_500, 1] = 0.0, 1.0  # a single row each spans the box
    good = np.arange(len(x)) < 18_000
    rows = spark.createDataFrame([(i, bool(g), r.tolist()) for i, (g, r) in enumerate(zip(good, x, strict=True))], "doc_id long, good boolean, features array<double>")
    seen = {}
    fit, told = quality.IsolationForest.fit_draws, quality.scores_without_own_fold
    monkeypatch.setattr(quality.IsolationForest, "fit_draws", lambda self, drawn, low, high: seen.setdefault("fits", []).append((drawn, low, high)) or fit(self, drawn, low, high))
    monkeypatch.setattr(quality, "scores_without_own_fold", lambda rows, forests: seen.setdefault("scores", told(rows, forests)))
    limit = quality.fitted(rows)[1]
    assert (np.min([f[1] for f in seen["fits"]], axis=0) == x.min(axis=0)).all() and (np.max([f[2] for f in seen["fits"]], axis=0) == x.max(axis=0)).all()
    assert len(seen["fits"]) == 1 + quality.FOLDS and all(len(d) == quality.DRAW for f in seen["fits"] for d in f[0])
    scores = seen["scores"].toPandas()
    assert len(scores) == len(x)  # was 6,000 at most
    assert limit == quality.calibrate(scores["score"].to_numpy(), scores["good"].to_numpy()) < 1
    again = quality.fitted(rows.repartition(5))
    assert again[1] == limit


def test_groups_of_scores_have_the_threshold_of_all_rows(spark):
    rng = np.random.default_rng(10)
    for n, step in ((3, 4), (60, 7), (3_000, 50), (3_000, 10_000)):
        scores, good = np.floor(rng.random(n) * step) / step, rng.random(n) < 0.8
        good[:2] = True, False
        scored = spark.createDataFrame(list(zip(map(bool, good), map(float, scores), strict=True)), "good boolean, score double")
        for most in (0.002, 0.1, 0.5):
            assert quality.threshold(scored, int(good.sum()), int((~good).sum()), most) == quality.calibrate(scores, good, most)


def plain_path(tree, row, at=0):
    """Cuts down to a leaf, one by one, with what the leaf's rows would still take."""
    feature, value, child, path = tree
    if feature[at] < 0:
        return path[at]
    return plain_path(tree, row, child[at][int(row[feature[at]] >= value[at])])


def test_scores_equal_a_plain_recursion_over_the_cuts():
    x = np.random.default_rng(6).random((300, 5))
    forest = quality.IsolationForest(trees=20).fit(x[:250], x)
    want = [2 ** (-np.mean([plain_path(t, row) for t in forest.forest]) / forest.scale) for row in x]
    assert np.allclose(forest.score(x), want, rtol=1e-12)
    for feature, _, child, path in forest.forest:  # a leaf at depth d has d, and more only where several rows are left
        depths = {0: 0}
        for at in range(len(feature)):
            if feature[at] >= 0:
                for c in child[at]:
                    depths[int(c)] = depths[at] + 1
            else:
                assert path[at] >= depths[at] and (depths[at] == forest.depth or path[at] == depths[at])
