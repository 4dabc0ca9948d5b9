import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import dedup
from rillflow.llm.wordtable import U64, WordTable, mix


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
                parent[max(top(a), top(b), key=lambda k: rows[k][0])] = min(top(a), top(b), key=lambda k: rows[k][0])
    return {rows[k][0]: (len(sets[k]), rows[top(k)][0]) for k in range(len(rows))}


def edited(rng, base, n):
    w = base.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def check(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dedup.groups(docs).collect()}
    assert got == brute(rows)


def test_chains_and_groups_equal_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(dedup, "FEW", 4)  # so that the prefix filter has work
    rng = random.Random(5)
    rows, n = [], 0
    for size, edits in ((40, 1), (40, 2), (40, 4), (3, 1), (2, 0), (1, 0)):
        text = " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(80, 160)))
        for _ in range(size):
            rows.append((n, edited(rng, text, rng.randrange(edits + 1))))
            n += 1
    chain = " ".join(f"c{k}" for k in range(200))
    for _ in range(12):  # each close to the last only
        rows.append((n, chain))
        chain, n = edited(rng, chain, 1), n + 1
    check(docs_of(*rows), rows)


def test_cases(spark, docs_of):
    rows = [(9, "a b c"), (4, "A  b\tc"), (5, None), (6, ""), (7, " \n "), (8, "É b c d e f"), (3, "é b c d e f"), (2, "a b"), (1, "word " * 60_000), (0, "word " * 5)]
    docs = docs_of(*rows).withColumn("key", F.lit(1)).withColumn("n", F.lit("x")).withColumn("component", F.lit(2))
    check(docs, rows)
    again = docs.unionByName(docs.where("doc_id = 9")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = dedup.groups(again).collect()
    assert len(got) == 12 and sum(r["doc_id"] == 9 for r in got) == 2
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, None)]
    assert dedup.groups(docs.limit(0)).count() == 0
    kept = dedup.one_of_each(again).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 2, 3, 4, 5, 6, 7, 8]
    assert set(kept[0].asDict()) == set(docs.columns)


def test_rows_of_repeated_and_null_ids_go_by_text(spark, docs_of):
    docs = docs_of((1, "a b c d e f g"), (1, "h i j k l m n"), (1, "h i j k l m n"), (2, "o p q r s t u"), (None, "o p q r s t u"), (None, "v w x y z a b"), (None, "v w x y z a b"), (3, ""), (3, ""), (None, None))
    kept = sorted(((r["doc_id"], r["text"]) for r in dedup.one_of_each(docs.repartition(3)).collect()), key=str)
    assert kept == sorted([(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "o p q r s t u"), (None, "v w x y z a b"), (3, ""), (None, None)], key=str)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = mix(rng.integers(0, 2**62, 3000).astype(np.uint64))
    a, b = np.unique(pool[:2000]), np.unique(pool[200:2200])
    r = dedup.registers(np.concatenate([a, b, np.union1d(a, b)]), np.array([len(a), len(b), len(np.union1d(a, b))]))
    assert (np.maximum(r[0], r[1]) == r[2]).all()
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(dedup.similarity(r[:1], r[1:2], np.array([len(a)]), np.array([len(b)]))[0] - truth) < 0.13
    assert dedup.similarity(r[:1], r[:1], np.array([50.0]), np.array([50.0]))[0] == 1
    assert (dedup.registers(np.array([5], np.uint64), np.array([1])) > 0).all()


def test_word_hashes_depend_on_bytes_alone():
    t = WordTable(["ab cd", None, "x ab", "cd\x0bab\tcd "])
    h = t.word_hashes()
    assert h[0] == h[3] == h[5] and h[1] == h[4] == h[6] and len(set(map(int, h))) == 3
    assert t.first.tolist() == [0, 2, 2, 4, 7]
    assert mix(np.array([1], np.uint64)).dtype == U64


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(5, 1), (3, 5), (9, 3), (7, 8)], [(k, k + 1) for k in range(40)]])
def test_components(spark, edges):
    got = {r["doc"]: r["component"] for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {v: v for e in edges for v in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
