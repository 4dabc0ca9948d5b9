"""Repair of conversations whose rows were damaged: the cheapest edits that bring the roles into order.

A repaired conversation's role initials are ``(s?(ua)+)?``.  A row is kept (K,
free), given the role that fits (R, 1) or deleted (D, 2; a must for blank and
repeated rows); rows without text may be inserted anywhere (I, 5); a row that
is cut short costs 5 more unless it is deleted.  Of the cheapest edits those
of least initials hold.

A conversation's rows are cut into segments of ``SEGMENT`` rows.  Segments are
hash-partitioned, and in each batch of them one recursive DuckDB query takes
all segments a row further at a time, keeping for each state of the grammar
that a segment may begin in, and each that it may be in now, the least cost and
of that the least initials.  What a segment comes to is a table of states, and
such tables are put together ``SEGMENT`` at a time by the same query, until
each conversation has one.  So no task needs a whole conversation, and short
ones, which are one segment, take one pass.  Two edits of one length and cost
compare alike whatever follows them, and neither begins with the other (both
end in a row's own letter, after equally many rows), so the least per state is
enough.

Order: by turn, nulls first, then by role and by the SHA-256 of role and text,
as damaged; rows that are equal in all of these don't differ.  Text goes
through two exchanges: to meet its row's edit, and to be hashed.  A digest of
a whole conversation takes its lines in order by its definition; the task that
makes it holds no more than the hash's state.

Cases: a null role, text or part of the damage's key counts as one space; a
null conv_id is a conversation; repeated rows are rows (the later ones are
duplicates); blank rows, conversations of which no row is left, and tables
without rows give what the contract says; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .common import cut, importable

SEGMENT = 64
BATCH = 20_000  # rows, or tables of states, that one query takes
PART_ROWS = 200_000
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
SHORT_COST = 5  # of a row that is cut short and not deleted
ROLES = {"u": "user", "a": "assistant"}
NEXT = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}  # roles that may follow each state, the last role so far
STATES = list(NEXT)
DONE = ("", "a")
BLANK = r"[\x20\x09-\x0D]"


def _inserted(state: str) -> Iterator[tuple[str, int, str]]:
    """State, cost and initials after no, one and two inserted rows; more would come back to a state at a higher cost."""
    for k in range(3):
        yield state, k * COSTS[INSERT], INSERT * k
        state = NEXT[state][-1]


def _moves() -> list[tuple]:
    """(code, source, target, cost, initials): all a row can come to.

    A row's code is its role's initial, o for any other than s, u and a, in
    capitals if it is cut short, or x if it must go.
    """
    found = []
    for source, code in itertools.product(STATES, "suaoSUAOx"):
        short = SHORT_COST if code.isupper() else 0
        for state, cost, initials in _inserted(source):
            found.append((code, source, state, cost + COSTS[DELETE], initials + DELETE))
            if code != "x":
                if code.lower() in NEXT[state]:
                    found.append((code, source, code.lower(), cost + short, initials + KEEP))
                found.append((code, source, NEXT[state][-1], cost + short + COSTS[REROLE], initials + REROLE))
    return [(c, STATES.index(s), STATES.index(t), cost, e) for c, s, t, cost, e in found]


def _ends() -> list[tuple[int, str] | None]:
    """For each state the least cost and initials of the inserted rows that end a conversation in it."""
    return [min((cost, e) for s, cost, e in _inserted(state) if s in DONE) for state in STATES]


STEPS_OF_ROWS = "SELECT id, nth, source, target, m.cost, letters FROM (SELECT id, codes, unnest(range(1, length(codes) + 1)) AS nth FROM groups) g JOIN moves m ON m.code = codes[nth]"
STEPS_OF_TABLES = "SELECT id, nth, s.source, s.target, s.cost, s.letters FROM (SELECT id, nth, unnest(tables[nth]) AS s FROM (SELECT id, tables, unnest(range(1, len(tables) + 1)) AS nth FROM groups))"
RUN = """WITH RECURSIVE steps AS MATERIALIZED ({steps}), run AS (
  SELECT id, n, state AS start, state, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS cost, '' AS letters FROM groups, (SELECT unnest(range(4)) AS state) WHERE state = 0 OR NOT leads
  UNION ALL
  SELECT id, n, start, target, nth, best.cost, best.letters FROM (
    SELECT r.id, r.n, r.start, s.target, s.nth, min({{'cost': r.cost + s.cost, 'letters': r.letters || s.letters}}) AS best
    FROM run r JOIN steps s ON s.id = r.id AND s.nth = r.nth + 1 AND s.source = r.state GROUP BY r.id, r.n, r.start, s.target, s.nth))
SELECT id, list({{'source': CAST(start AS INTEGER), 'target': CAST(state AS INTEGER), 'cost': cost, 'letters': letters}}) AS cells FROM run WHERE nth = n GROUP BY id ORDER BY id"""
CELLS = "array<struct<source:int,target:int,cost:bigint,letters:string>>"
CELLS_ARROW = pa.list_(pa.struct([("source", pa.int32()), ("target", pa.int32()), ("cost", pa.int64()), ("letters", pa.string())]))


def _advanced(groups: DataFrame, column: str, steps: str) -> DataFrame:
    """_c, seg, leads and cells (the table of states) of each group of a sequence ``column`` (codes of rows or tables of segments) of length n."""
    importable(groups.sparkSession)
    moves = _moves()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
        code, source, target, cost, letters = (list(c) for c in zip(*moves, strict=True))
        con.register("moves", pa.table({"code": code, "source": source, "target": target, "cost": pa.array(cost, pa.int64()), "letters": letters}))
        for batch in it:
            rows, first = batch.column("n").to_pylist(), 0
            while first < len(rows):
                last, total = first, 0
                while last < len(rows) and (last == first or total + rows[last] <= BATCH):
                    total += rows[last]
                    last += 1
                part = batch.slice(first, last - first)
                con.register("groups", pa.table({"id": pa.array(range(len(part)), pa.int64()), **{c: part.column(c) for c in ("n", "leads", column)}}))
                cells = con.sql(RUN.format(steps=steps)).to_arrow_table().column("cells").combine_chunks()
                cells = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
                yield pa.RecordBatch.from_arrays([part.column("_c"), part.column("seg"), part.column("leads"), cells.cast(CELLS_ARROW)], ["_c", "seg", "leads", "cells"])
                con.unregister("groups")
                first = last

    return groups.select("_c", "seg", "leads", "n", column).mapInArrow(batches, f"_c string, seg long, leads boolean, cells {CELLS}")


def damaged(conversations: DataFrame) -> DataFrame:
    """_c (the conversation), turn, role, text after the damage that each row's conv_id and turn decide."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(what == 1, "").when(what == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    rows = conversations.select(_conversation(), F.col("turn").cast("long").alias("turn"), F.when(what == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), what.alias("what"))
    copies = F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("what <> 0").withColumn("copy", F.explode(copies)).drop("what", "copy")


def _conversation() -> Column:
    """conv_id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("_c")


def _same() -> Column:
    """What tells role and text from others."""
    return F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256)).alias("same")


def numbered(rows: DataFrame) -> DataFrame:
    """Damaged rows without their texts: _c, nth (from 0), turn, role, same, code, initial, and booleans blank, duplicate, truncated."""
    spark = rows.sparkSession
    blank = ~F.col("text").rlike(f"[^{BLANK[1:]}")
    plain = rows.select("_c", "turn", "role", _same(), blank.alias("blank"), (~F.col("text").rlike(f"[.!?]{BLANK}*\\z")).alias("open"), F.monotonically_increasing_id().alias("_u"))
    parts = max(spark.sparkContext.defaultParallelism, -(-plain.count() // PART_ROWS))
    order = ["_c", "turn", "role", "same", "_u"]  # the last deals out rows that are equal in all else
    ordered = plain.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_u").withColumn("at", F.monotonically_increasing_id())
    ordered = cut(ordered.withColumn("range", F.shiftright("at", 33)))  # the numbers are taken once
    runs = ordered.groupBy("_c", "range").agg(F.min("at").alias("low"), F.count("*").alias("n"))  # of a conversation, one a range
    before = F.coalesce(F.sum("n").over(W.partitionBy("_c").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("_c", "range", (before - F.col("low")).alias("shift"))
    firsts = ordered.groupBy("_c", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    told = ordered.join(firsts, "at", "left").join(runs, ["_c", "range"])
    again = ~F.col("blank") & F.col("first").isNull()
    short = ~F.col("blank") & ~again & F.col("open")
    initial = F.substring("role", 1, 1)
    code = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return told.select(
        "_c", (F.col("at") + F.col("shift")).alias("nth"), "turn", "role", "same", initial.alias("initial"), "blank", again.alias("duplicate"), short.alias("truncated"),
        F.when(F.col("blank") | again, "x").when(short, F.upper(code)).otherwise(code).alias("code"),
    )


def segments(rows: DataFrame) -> DataFrame:
    """_c, seg, leads, n, codes, and the counts of faults, of every ``SEGMENT`` rows; a segment's last row is seen by the next as well, for the pair that they make."""
    own = F.floor(F.col("nth") / SEGMENT)
    dealt = rows.withColumn("seg", F.explode(F.when(F.col("nth") % SEGMENT == SEGMENT - 1, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("own", F.col("seg") == own)
    listed = F.sort_array(F.collect_list(F.struct("nth", "own", "code", "initial")))  # at most SEGMENT + 1
    count = lambda c: F.count_if(F.col("own") & F.col(c)).alias(c)
    grouped = dealt.groupBy("_c", "seg").agg(listed.alias("rows"), F.count_if("own").alias("n"), *map(count, ("blank", "duplicate", "truncated"))).where("n > 0")
    pairs = F.transform(F.sequence(F.lit(1), F.size("rows") - 1), lambda k: F.concat(F.get("rows", k - 1)["initial"], F.get("rows", k)["initial"]))
    illegal = F.when(F.size("rows") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    codes = F.array_join(F.transform(F.filter("rows", lambda r: r["own"]), lambda r: r["code"]), "")
    return grouped.select("_c", "seg", (F.col("seg") == 0).alias("leads"), "n", codes.alias("codes"), "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"))


def cheapest(parts: DataFrame) -> DataFrame:
    """_c, cost, audit of each conversation, from its segments."""
    tables = cut(_advanced(parts, "codes", STEPS_OF_ROWS), few=True)
    last = tables.agg(F.max("seg")).first()[0] or 0
    while last:
        groups = tables.groupBy("_c", F.floor(F.col("seg") / SEGMENT).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("seg", "cells"))).alias("rows"))  # at most SEGMENT
        groups = groups.select("_c", "seg", (F.col("seg") == 0).alias("leads"), F.size("rows").cast("long").alias("n"), F.transform("rows", lambda r: r["cells"]).alias("tables"))
        alone = groups.where("n = 1").select("_c", "seg", "leads", F.get("tables", F.lit(0)).alias("cells"))
        tables = cut(alone.unionByName(_advanced(groups.where("n > 1"), "tables", STEPS_OF_TABLES)), few=True)
        last //= SEGMENT
    ends = F.array(*[F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(letters).alias("letters")) for cost, letters in _ends()])
    total = F.transform(F.filter("cells", lambda c: c["source"] == 0), lambda c: F.struct((c["cost"] + F.get(ends, c["target"])["cost"]).alias("cost"), F.concat(c["letters"], F.get(ends, c["target"])["letters"]).alias("audit")))
    return tables.withColumn("best", F.array_min(total)).select("_c", "best.cost", "best.audit")


def edits_of(audit: str) -> Iterator[tuple[int, list[str], str | None]]:
    """(nth, roles inserted before it, the role it gets, '' for its own) of each row that stays; rows inserted at the end are before one that isn't there, of role None.

    Roles are told from the end, where every other one is the assistant's.
    """
    left, nth, waiting = sum(c != DELETE for c in audit), 0, []
    for letter in audit:
        if letter == DELETE:
            nth += 1
            continue
        left -= 1
        role = ROLES["u" if left % 2 else "a"]
        if letter == INSERT:
            waiting.append(role)
            continue
        yield nth, waiting, "" if letter == KEEP else role
        nth, waiting = nth + 1, []
    if waiting:
        yield nth, waiting, None


def _edits(audits: DataFrame) -> DataFrame:
    """_c, nth, inserted, new_role of the rows that stay."""
    importable(audits.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for c, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = edits_of(audit)
                while some := list(itertools.islice(found, BATCH)):
                    nth, inserted, role = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(nth)), pa.array(nth, pa.int64()), pa.array(inserted, pa.list_(pa.string())), pa.array(role, pa.string())], ["_c", "nth", "inserted", "new_role"])

    return audits.select("_c", "audit").mapInArrow(batches, "_c string, nth long, inserted array<string>, new_role string")


def repaired(rows: DataFrame, told: DataFrame, audits: DataFrame) -> DataFrame:
    """_c, nth, lines: the repaired conversations, in order of nth; of ``rows`` with their texts, ``told`` the same numbered."""
    edits = _edits(audits)
    stays = told.select("_c", "nth", "role", "same").join(edits.where("new_role is not null"), ["_c", "nth"])
    texts = rows.select("_c", _same(), "text").dropDuplicates(["_c", "same"])
    inserted = F.transform("inserted", lambda r: F.concat(r, F.lit(":")))
    own = F.concat(F.when(F.col("new_role") == "", F.col("role")).otherwise(F.col("new_role")), F.lit(":"), "text")
    # of rows of one role and text all but the first are deleted, so each text has one row
    lines = stays.join(texts, ["_c", "same"]).select("_c", "nth", F.concat(inserted, F.array(own)).alias("lines"))
    return lines.unionByName(edits.where("new_role is null").select("_c", "nth", inserted.alias("lines")))


def digests(lines: DataFrame) -> DataFrame:
    """_c and the SHA-256 of its newline-joined lines."""
    importable(lines.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in it:
            done = []
            for c, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c == key:
                    digest.update(b"\n")
                else:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = c, hashlib.sha256()
                digest.update("\n".join(some).encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["_c", "repaired_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["_c", "repaired_sha256"])

    dealt = lines.repartition("_c").sortWithinPartitions("_c", "nth").select("_c", "lines")
    return dealt.mapInArrow(batches, "_c string, repaired_sha256 string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, the counts of ``COUNTS``, audit and repaired_sha256 of every conversation."""
    rows = damaged(conversations)
    told = cut(numbered(rows), few=True)
    parts = cut(segments(told), few=True)
    audits = cut(cheapest(parts), few=True)
    faults = parts.groupBy("_c").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    turns = told.where("turn is not null").groupBy("_c", "turn").agg(F.lit(1).alias("n")).groupBy("_c").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    found = conversations.groupBy(_conversation()).agg(F.first("conv_id").alias("conv_id"))
    for more in (faults, turns, audits, digests(repaired(rows, told, audits))):
        found = found.join(more, "_c", "left")
    empty = hashlib.sha256(b"").hexdigest()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
