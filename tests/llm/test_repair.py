import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rillflow.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
WORDS = r"[^\x20\x09-\x0D]"


def damage(rows):
    found = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if what:
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            found += [(conv, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return found


def ordered(rows):
    same = lambda r: hashlib.sha256(f"{r[2]}\0{r[3]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), same(r)))


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        words = re.findall(WORDS, text)
        found.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def all_edits(rows, kinds):
    """Least (cost, audit) and its lines over all edits with at most two rows inserted in a gap, one by one."""
    best = None
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]

    def options(row, kind):
        extra = 5 if kind == "truncated" else 0
        yield 2, "D", None
        if kind not in ("blank", "duplicate"):
            yield extra, "K", row[2]
            for role in ("user", "assistant"):
                yield 1 + extra, "R", role

    for inserted in itertools.product(gaps, repeat=len(rows) + 1):
        if sum(map(len, inserted)) > 2:
            continue
        for picked in itertools.product(*[list(options(r, k)) for r, k in zip(rows, kinds, strict=True)]):
            cost, audit, lines = 0, "", []
            for k, some in enumerate(inserted):
                for role in some:
                    cost, audit = cost + 5, audit + "I"
                    lines.append((role, ""))
                if k < len(rows):
                    cost, audit = cost + picked[k][0], audit + picked[k][1]
                    if picked[k][2] is not None:
                        lines.append((picked[k][2], rows[k][3]))
            if GRAMMAR.match("".join(r[:1] if r[:1] in ("s", "u", "a") else "o" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, lines
    return best


def dynamic(rows, kinds):
    """The same, by a plain table of states over rows of any number."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    state = {"": (0, "", ())}

    def put(to, key, value):
        if key not in to or value[:2] < to[key][:2]:
            to[key] = value

    def inserts(state):
        out = {}
        for key, (cost, audit, lines) in state.items():
            for n in range(3):
                put(out, key, (cost + 5 * n, audit + "I" * n, lines))
                key = after[key][-1]
                lines = (*lines, ({"u": "user", "a": "assistant"}[key], ""))
        return out

    def candidates(state):
        for key, (cost, audit, lines) in state.items():
            for n in range(3):
                yield key, cost + 5 * n, audit + "I" * n, lines
                key = after[key][-1]
                lines = (*lines, ({"u": "user", "a": "assistant"}[key], ""))

    for (_, _, role, text), kind in zip(rows, kinds, strict=True):
        to = {}
        extra = 5 if kind == "truncated" else 0
        for key, cost, audit, lines in candidates(state):
            put(to, key, (cost + 2, audit + "D", lines))
            if kind not in ("blank", "duplicate"):
                if role[:1] and role[:1] in after[key]:
                    put(to, role[:1], (cost + extra, audit + "K", (*lines, (role, text))))
                fit = after[key][-1]
                put(to, fit, (cost + extra + 1, audit + "R", (*lines, ({"u": "user", "a": "assistant"}[fit], text))))
        state = to
    done = inserts(state)
    return min(done[k] for k in ("", "a") if k in done)


def plain(rows, cheapest=dynamic):
    found = {}
    left = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = ordered([r for r in left if r[0] == conv])
        kinds = faults(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        initials = [r[2][:1] for r in mine]
        cost, audit, lines = cheapest(mine, kinds)
        found[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
        )
    return found


def found(df):
    listed = df.collect()
    by_id = {r["conv_id"]: tuple(r[c] for c in (*repair.COUNTS, "audit", "repaired_sha256")) for r in listed}
    assert len(by_id) == len(listed)
    return by_id


def some(n, seed, longest=8):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t", None, "a b.", "x. ", "end.\n", "ü…", "two\nlines."]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "User"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), role, rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    rng.shuffle(rows)
    return rows


def test_tables_of_states_equal_all_edits_one_by_one():
    for rows in ([(0, k, r, t) for k, (r, t) in enumerate(x)] for x in itertools.product(itertools.product(("system", "user", "assistant", "tool"), ("a.", "cut", "")), repeat=2)):
        kinds = faults(rows)
        mine, every = dynamic(rows, kinds), all_edits(rows, kinds)
        assert mine[:2] == every[:2] and list(mine[2]) == list(every[2])


def test_some_longer_ones_equal_all_edits():
    rng = random.Random(4)
    for _ in range(25):
        rows = [(0, k, rng.choice(["system", "user", "user", "assistant", "tool"]), rng.choice(["a.", "b.", "cut", ""])) for k in range(4)]
        kinds = faults(rows)
        mine, every = dynamic(rows, kinds), all_edits(rows, kinds)
        assert mine[:2] == every[:2] and list(mine[2]) == list(every[2])


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_loops(spark, seed):
    rows = some(150, seed)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"nth": F.lit("clash"), "_c": F.lit(1), "same": F.lit(2), "seg": F.lit(3)})
    assert found(repair.repair(table)) == plain(rows)


def test_long_conversations_are_put_together_from_segments(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(conv, turn, rng.choice(["user", "assistant", "system"]), f"t {rng.randrange(400)}{rng.choice(['.', '.', ''])}") for conv, n in ((1, 700), (2, 9), (3, 64), (4, 65), (5, 5)) for turn in range(n)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows)
    assert found(repair.repair(table)) == want
    monkeypatch.setattr(repair, "SEGMENT", 4)  # five levels
    monkeypatch.setattr(repair, "PART_ROWS", 50)
    assert found(repair.repair(table)) == want


def test_edits_are_told_from_the_end():
    assert list(repair.edits_of("KDKRI")) == [(0, [], ""), (2, [], ""), (3, [], "user"), (4, ["assistant"], None)]
    assert list(repair.edits_of("IRDD")) == [(0, ["user"], "assistant")] and list(repair.edits_of("")) == [] and list(repair.edits_of("DD")) == []


def test_cases(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "x."), (None, None, None, None), (-1, None, "user", "Same."), (-1, None, "user", "Same."), (-1, 5, "assistant", "Yes.")]
    got = found(repair.repair(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows) and got[gone] == (0, 0, 0, 0, 0, 0, "", empty) and got[None][:2] == (0, 1)
    same = [(7, 3, "user", "Same.")] * 200
    assert found(repair.repair(spark.createDataFrame(same, SCHEMA))) == plain(same)


def test_query_over_the_small_table(spark, small):
    rows = [tuple(r) for r in small("conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op13_conversation_repair(spark, "/root/testdata/sf0.01")) == plain(rows)
