import tracemalloc
import collections
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rillflow.llm import mixing, sharding


def check_shards(docs, texts, shards=24):
    got = sharding.shard(docs, shards).collect()
    assert len(got) == len(texts)
    held = {}
    for r in got:
        held.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in held.values()) and all(0 <= k < shards for k in held)
    sizes = [len(held.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert {r["law"] for r in got} <= {"rows"} and all(r["grown_shard"] is None for r in got)
    return got


def test_even_rows_and_whole_groups(spark, docs_of):
    rng = random.Random(1)
    texts = [f"single {k}" for k in range(300)] + ["hot"] * 400 + [f"g{k // 5}" for k in range(200)] + [None, None, "", "é" * 10]
    rng.shuffle(texts)
    got = check_shards(docs_of(*texts).withColumn("shard", F.lit("clash")).withColumn("key", F.lit(1)), texts)
    by_id = {r["doc_id"]: r for r in got}
    homes = {}
    for k, t in enumerate(texts):
        r, data = by_id[k], (t or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
        homes.setdefault(t or "", set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in homes.items() if t.startswith("g"))
    assert len(homes["hot"]) == 11  # 400 rows in shards of 37


@pytest.mark.parametrize("texts", [[], ["a"], ["a"] * 30, [None] * 3, [f"t{k}" for k in range(25)], ["a", "a", "b", "b"] * 30])
def test_small_tables(spark, docs_of, texts):
    check_shards(docs_of(*texts), texts)
    check_shards(docs_of(*texts), texts, shards=3)


def test_repeated_and_null_rows(spark, docs_of):
    docs = docs_of((1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (2, "x" * 300_000))
    check_shards(docs, [0] * 6)


def plain_propagation(rows, shards, rounds, order):
    """Label propagation under quotas with plain loops: rows of (key, label); the rows of each (key, shard) that moved as a whole."""
    capacity, used, home = len(rows) // shards, [0] * shards, {}
    total = collections.Counter(k for k, _ in rows)
    seen = collections.Counter(rows)
    over = collections.Counter(s for k, s in rows if total[k] > capacity)
    apart = sorted(range(shards), key=lambda s: (-over[s], s))[: -(-over.total() // capacity)]
    for _ in range(rounds):
        wants = collections.defaultdict(list)
        for key in {k for k, n in total.items() if n > 1 and k not in home}:
            open_ = [(n, capacity - used[s], s) for (k, s), n in seen.items() if k == key and s not in apart and total[key] <= capacity - used[s]]
            if open_:
                wants[max(open_)[2]].append(key)
        moved = 0
        for s, keys in wants.items():
            so_far, room = 0, capacity - used[s]
            for key in sorted(keys, key=lambda k: (order[k], -total[k], k)):
                so_far += total[key]
                if so_far <= room:
                    home[key] = s
                    used[s] += total[key]
                    moved += 1
        if not moved:
            break
    return home


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_labels_spread_as_in_plain_loops(spark, docs_of, seed):
    rng = random.Random(seed)
    texts = [f"g{min(int(rng.expovariate(0.08)), 60)}" for _ in range(300)] + [f"single {k}" for k in range(100)] + ["hot"] * 120
    docs = docs_of(*texts)
    keyed = sharding._keyed(docs, 6).withColumn("part", 1 + F.pmod(F.xxhash64("key"), F.lit(sharding.LEAST_PARTS))).collect()
    total = collections.Counter(bytes(r["key"]) for r in keyed)
    order = {bytes(r["key"]): 0 if total[bytes(r["key"])] >= 2 else r["part"] for r in keyed}  # all groups are big in so small a table
    home = plain_propagation([(bytes(r["key"]), r["start"]) for r in keyed], 6, sharding.ROUNDS, order)
    shard_of = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 6).collect()}
    assert home and all(shard_of[r["doc_id"]] == home[bytes(r["key"])] for r in keyed if bytes(r["key"]) in home)
    cuts = lambda of: sum(of[a] != of[b] for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] == texts[b])
    links = sharding.cut_links(sharding.shard(docs, 6)).first()
    assert links["cut"] == cuts(shard_of) and links["links"] == sum(n * (n - 1) // 2 for n in total.values())
    assert links["cut"] < 0.45 * cuts({r["doc_id"]: r["start"] for r in keyed})


def test_shards_do_not_follow_the_partitions(spark, docs_of):
    docs = docs_of(*[(k % 150 if k % 11 else None, f"text {k % 37}" if k % 3 else "hot") for k in range(400)])
    docs = docs.unionByName(docs.where("doc_id < 20"))
    as_rows = lambda df: sorted(map(str, sharding.shard(df).collect()))
    want = as_rows(docs.repartition(7))
    assert want == as_rows(docs.coalesce(1)) == as_rows(docs.repartition(3, "text").sort("text"))


def test_plan_has_no_python(spark, docs_of):
    plan = sharding.shard(docs_of("a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_targets():
    assert mixing.targets([100, 100, 100]) == [200.0, 250 * 1 / 3, 250 * 2 / 3]
    assert mixing.targets([10, 10_000, 10]) == [20.0, 15_030 - 40.0, 20.0]
    assert mixing.targets([]) == [] and mixing.targets([0, 5]) == [0.0, 7.5]
    for sizes in ([7, 1, 900, 33, 2], [1] * 9):
        t = mixing.targets(sizes)
        assert abs(sum(t) - 1.5 * sum(sizes)) < 1e-6 and all(a <= 2 * s + 1e-9 for a, s in zip(t, sizes))


def test_knapsack_is_nearest():
    rng = random.Random(6)
    for _ in range(300):
        lengths = rng.sample(range(1, 40), rng.randrange(1, 5))
        counts = [rng.randrange(1, 4) for _ in lengths]
        budget = rng.randrange(0, 150)
        taken = mixing.knapsack(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        sums = {sum(n * x for n, x in zip(ns, lengths)) for ns in itertools.product(*[range(c + 1) for c in counts])}
        got = sum(n * x for n, x in zip(taken, lengths))
        assert abs(got - budget) == min(abs(s - budget) for s in sums if s <= max(2 * budget, 0) or budget == 0)


def test_knapsack_of_many_even_lengths_stays_small():
    lengths, counts, budget = list(range(2, 20_002, 2)), [3] * 10_000, 199_999
    tracemalloc.start()
    taken = mixing.knapsack(lengths, counts, budget)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(sum(a * b for a, b in zip(lengths, taken, strict=True)) - budget) == 1 and all(t <= 3 for t in taken)
    assert peak < 50 << 20
    taken = mixing.knapsack(lengths, [1] * 10_000, 777)  # no sum is odd: all lengths in vain
    assert sum(a * b for a, b in zip(lengths, taken, strict=True)) == 776
    assert mixing.knapsack([7, 7, 14], [1, 1, 1], 3) == [0, 0, 0] and sum(mixing.knapsack([7], [1], 4)) == 1


def test_mix(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "KNAPSACK_WORDS", 200)
    rng = random.Random(2)
    rows = [(k, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))), "en", rng.choice(["a", "b", "Z", "é", None, ""])) for k in range(600)]
    rows += [(k, "same text of five words", "en", "hot") for k in range(600, 900)]
    docs = docs_of(*rows).withColumn("size", F.lit("clash")).withColumn("rank", F.lit(1))
    got = mixing.mix(docs).collect()
    assert len(got) == 900 and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    size = {k: len(t.split()) for k, t, _, _ in rows}
    source = {k: s for k, _, _, s in rows}
    order = sorted({s for s in source.values()}, key=lambda s: (s is None, (s or "").encode()))
    totals = [sum(size[k] for k in size if source[k] == s) for s in order]
    target = dict(zip(order, mixing.targets(totals)))
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["target"] == target[s] and r["source_size"] == totals[order.index(s)]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 3 for s in order)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["taken"] // r["size"] for r in got if r["size"])


def test_rows_of_repeated_and_null_ids_are_mixed_by_row(spark, docs_of):
    rows = [(None if k % 2 else k // 3, "w " * (k % 7 + 1), None, "ab"[k % 3 > 0]) for k in range(120)]
    docs = docs_of(*rows)
    taken = sum(r["taken"] for r in mixing.mix(docs).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sum(len(r["text"].split()) for r in mixed.collect()) == taken


def test_mix_cases(spark, docs_of):
    docs = docs_of((1, None, None, None), (2, "", None, "a"), (None, "x y", None, "a"), (3, "x y", None, "a"), (3, "x y", None, "a"), (4, "w " * 300_000, None, "b"))
    got = mixing.mix(docs).collect()
    assert len(got) == 6 and {r["taken"] for r in got if not r["size"]} == {0}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("doc_id = 1")).first()["target"] == 0.0
