import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from rillflow.llm import audit, queries

LABELS = "doc_id long, quality int, toxic int"
NAMES = ("part", "filter_order", "step", *audit.COUNTS)


def plain(docs, labels):
    """All orders applied one after the other to (doc_id, text, source) rows."""
    good, toxic = ({i for i, *kinds in labels if i is not None and kinds[k] == 1} for k in (0, 1))
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None, "E": i is not None and first[text] < i,
        }
        rows.append((source or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for step, f in enumerate(order, 1):
                lost = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = sum(f in r[1] for r in here)
                sums[f] += len(lost)
                out[part, order, step] = [len(left), len(lost), fails - len(lost), sum(r[1] == {f} for r in here), sum(r[2] for r in lost), sum(r[3] for r in lost)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def found(rows):
    assert rows.columns == list(NAMES)
    listed = [tuple(r) for r in rows.collect()]
    assert len(listed) == len(set(listed))
    return set(listed)


def some_docs(n, seed):
    rng = random.Random(seed)
    texts = ["", None, "Short one", "UPPER " * 60, " ".join(f"word{k}" for k in range(60)), "a|b " + " ".join(f"w{k}" for k in range(80)), "same " * 70, "é" * 63, "é" * 64, "é" * 65]
    texts += [" ".join(rng.choice(["the", "Of", "X$", "a", f"n{k}"]) for k in range(rng.randrange(200))) for _ in range(n // 3)]
    long = " ".join(f"t{k}" for k in range(3000))
    texts += [long, long + "!", long + "?", long[:-1] + "x", "z" + long[1:]]
    return [(rng.choice([None, *range(n)]), rng.choice(texts), rng.choice(["a", "b", "c", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_orders_one_by_one(spark, seed):
    docs = some_docs(150, seed)
    labels = [(k % 100, k % 3 == 0 or None, int(k % 7 == 0)) for k in range(0, 160, 2)]
    labels = [(i, None if q is None else int(q), t) for i, q, t in labels] + [(None, 1, 1)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"mask": F.lit("clash"), "part": F.lit(1), "class": F.lit(2), "at": F.lit(3), "n": F.lit(4)})
    marks = spark.createDataFrame(labels, LABELS).withColumn("part", F.lit("clash"))
    assert found(audit.audit(rows, marks)) == plain(docs, labels)


def test_hashes_that_meet_are_told_apart_by_the_texts(spark, monkeypatch):
    docs = some_docs(120, 3)
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string")
    want = plain(docs, [])
    none = spark.createDataFrame([], LABELS)
    monkeypatch.setattr(audit, "_hash", lambda *c: F.length(c[-1].cast("string")).cast("long") % 3)
    assert found(audit.audit(rows, none)) == want
    monkeypatch.setattr(audit, "MOST_BROADCAST", 0)
    monkeypatch.setattr(audit, "BIG_SHARE", 2)
    assert found(audit.audit(rows, none)) == want


def test_many_classes_are_joined_by_exchange(spark, monkeypatch):
    docs = [(k, f"text {k % 40}" if k % 3 else "hot", "s") for k in range(300)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string")
    monkeypatch.setattr(audit, "MOST_BROADCAST", 0)
    monkeypatch.setattr(audit, "BIG_SHARE", 4)
    assert found(audit.audit(rows, spark.createDataFrame([], LABELS))) == plain(docs, [])
    first = {}
    for i, text, _ in docs:
        first.setdefault(text, i)
    assert sorted(r[0] for r in audit.repeats(rows).collect()) == [i for i, text, _ in docs if first[text] < i]


def test_cases(spark, docs_of):
    none = spark.createDataFrame([], LABELS)
    assert audit.audit(docs_of("x").limit(0), none).count() == 0
    one = found(audit.audit(docs_of((5, None), (5, ""), (None, ""), (7, "")), none))
    assert one == plain([(5, None, None), (5, "", None), (None, "", None), (7, "", None)], [])
    twice = [(1, "a b", "s")] * 3 + [(2, "a b", "s")] * 2
    rows = spark.createDataFrame(twice, "doc_id long, text string, source string")
    assert found(audit.audit(rows, none)) == plain(twice, []) and audit.repeats(rows).count() == 2


def test_query_over_the_small_table(spark, corpus, small):
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in small("labels").collect()]
    rows = found(queries.op12_filter_audit(spark, "/root/testdata/sf0.01"))
    assert rows == plain([(i, t, s) for i, t, _, s in corpus], labels)
