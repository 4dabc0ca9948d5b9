"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Candidate spans are the fixed patterns' matches (those that fail their check
too) and looser forms: names, other phone and email spellings, social security
numbers, IBANs.  Regex, gazetteer and context labelers vote for or against
each.  Over the counts of all vote patterns, expectation-maximisation
estimates each labeler's reliability and each kind's prior.  The posteriors of
all candidates train a span classifier on shape and context: log odds of
features from expected counts, so that one sum over the table is all it needs.
It decides on the candidates that are not fixed-pattern spans.  Those that it accepts are added
where they overlap no other span.

Positions are code points, ends exclusive.  Work is linear in a text's length.

Cases: a null or empty text has no spans; repeated rows are scanned as often
as they occur; an empty table, or one without candidates, adds no spans; a
null doc_id is carried through; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_texts, ordered_documents

BASE = ("email", "ip", "card", "phone")
LOOSE = ("person", "phone_loose", "email_loose", "ssn", "iban")
KINDS = BASE + LOOSE
WIDTH = 512  # hashed features
LEAST = 0.5

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
PERSON = re.compile(r"[A-ZÀ-Þ][a-zà-ÿ]++(?: [A-ZÀ-Þ][a-zà-ÿ]++)++")
PHONE_LOOSE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
EMAIL_LOOSE = re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++ ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z]{2,}+(?![A-Za-z])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

# fixed values: common given names and titles, mail domains, and words before or after a span that speak for or against it
GIVEN = frozenset("""Alice Andrea Andreas Anna Anne Antonio Barbara Carlos Charles Christian Christopher Claire Claude Daniel David Elena Elizabeth Emily Emma
Francisco François George Hans Heinrich Isabel Isabelle James Jean Jennifer John Jorge José Joseph Juan Julia Jürgen Karen Karl Klaus Laura Linda Louis Lucas Luis
Manuel Margaret María Marie Mark Martin Mary Matthew Michael Michel Nicolas Olivia Pablo Patricia Paul Pedro Peter Philippe Pierre Richard Robert Sarah Sofia
Sophie Stefan Stephen Susan Thomas Ursula Walter William Wolfgang""".split())  # fmt: skip
TITLES = frozenset("mr mrs ms dr prof herr frau monsieur madame mme señor señora sr sra don doña".split())
MAILS = re.compile(r"(?i)\.(?:com|org|net|edu|io|de|fr|es|uk|eu)\Z")
FOR = frozenset("name names contact call phone tel telephone mobile fax email mail address ssn card iban account ip host born signed author from by nom nombre teléfono telefon téléphone correo adresse".split())
AGAINST = frozenset("version release section chapter figure table isbn issn article page order sku part no build id serial edition".split())
VOTES = ("shape", "gazetteer", "left", "right", "form")


class Candidate(NamedTuple):
    kind: str
    start: int
    end: int
    fixed: bool  # a span of the contract's patterns


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Candidate]:
    reach, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > reach and text[begin - 1] in LOCAL:
            begin -= 1
        reach = max(reach, at if begin == at else reach)
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield Candidate("email", begin, m.end(), True)
            reach = m.end()
        at = text.find("@", max(at + 1, reach))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _numbers(text: str) -> Iterator[Candidate]:
    if "." in text:
        for m in IP.finditer(text):
            yield Candidate("ip", *m.span(), all(map(_octet, m[0].split("."))))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            yield Candidate("card", *m.span(), 16 <= len(digits) <= 19 and luhn(digits))
    if "+" in text:
        for m in PHONE.finditer(text):
            yield Candidate("phone", *m.span(), 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15)
    for kind, pattern in (("phone_loose", PHONE_LOOSE), ("ssn", SSN), ("iban", IBAN)):
        for m in pattern.finditer(text):
            yield Candidate(kind, *m.span(), False)


def candidates(text: str) -> list[Candidate]:
    """All candidates of a text by kind as listed, then start."""
    found = list(_emails(text))
    if re.search("[0-9]", text):
        found += _numbers(text)
    found += [Candidate("person", *m.span(), False) for m in PERSON.finditer(text)]
    if "at" in text and ("[" in text or "(" in text):
        found += [Candidate("email_loose", *m.span(), False) for m in EMAIL_LOOSE.finditer(text)]
    return sorted(found, key=lambda c: (KINDS.index(c.kind), c.start))


def _context(text: str, c: Candidate) -> tuple[list[str], list[str]]:
    left, right = text[max(0, c.start - 40) : c.start], text[c.end : c.end + 40]
    words = re.compile(r"\w+")
    return [w.lower() for w in words.findall(left)][-3:], [w.lower() for w in words.findall(right)][:3]


def votes(text: str, c: Candidate) -> str:
    """One sign a labeler: + for, - against, 0 for no vote."""
    left, right = _context(text, c)
    inner = text[c.start : c.end]
    shape = "+" if c.fixed or c.kind in ("ssn", "iban", "email_loose", "phone_loose") else "0" if c.kind == "person" else "-"
    if c.kind == "person":
        gazetteer = "+" if inner.split(" ", 1)[0] in GIVEN or (left and left[-1] in TITLES) else "-"
    elif c.kind in ("email", "email_loose"):
        gazetteer = "+" if MAILS.search(inner) else "-"
    else:
        gazetteer = "-" if len({d for d in inner if d.isdigit()}) <= 2 else "0"
    before = "-" if any(w in AGAINST for w in left) else "+" if any(w in FOR or w in TITLES for w in left) else "0"
    after = "-" if any(w in AGAINST for w in right[:1]) else "+" if any(w in FOR for w in right[:1]) else "0"
    edge = c.start == 0 or text[c.start - 1] in " \t\n\r\"'(<[:=,;"
    close = c.end == len(text) or not text[c.end].isalnum()
    starts = c.kind == "person" and (c.start == 0 or text[max(0, c.start - 2) : c.start].rstrip(" ")[-1:] in ("", ".", "\n", "!", "?"))
    form = "-" if starts or not (edge and close) else "+"
    return shape + gazetteer + before + after + form


def features(text: str, c: Candidate) -> list[int]:
    """Numbers of the hashed features that hold: kind, shape, length, and neighbouring words."""
    left, right = _context(text, c)
    inner = text[c.start : c.end]
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if ch.isdigit() else "A" if ch.isupper() else "a" if ch.isalpha() else ch for ch in inner[:64]))
    words = inner.split(" ")
    named = [f"k={c.kind}", f"s={c.kind}:{shape[:12]}", f"n={c.kind}:{min(len(inner), 40) // 4}", f"w={c.kind}:{len(words)}"]
    named += [f"g={c.kind == 'person' and words[0] in GIVEN}", f"t={bool(left) and left[-1] in TITLES}", f"e={c.kind}:{text[max(0, c.start - 2) : c.start].rstrip(' ')[-1:] in ('', '.', chr(10))}", f"f={c.kind}:{c.fixed}"]
    named += [f"l={w}" for w in left[-2:]] + [f"r={w}" for w in right[:1]]
    return sorted({zlib.crc32(f.encode("utf-8", "surrogatepass")) % WIDTH for f in named})


def reliabilities(patterns: dict[tuple[str, str], int], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Posterior of each (kind, vote pattern), by EM over their counts; labelers are independent given the truth."""
    if not patterns:
        return {}
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], float)
    kinds = sorted({k for k, _ in keys})
    kind = np.array([kinds.index(k) for k, _ in keys])
    cast = np.array([["-0+".index(v) - 1 for v in p] for _, p in keys], float)
    p = np.clip(0.5 + 0.2 * cast.sum(axis=1), 0.05, 0.95)  # starts from the majority
    for _ in range(rounds):
        mass = np.stack([n * (1 - p), n * p])
        prior = np.array([(mass[1][kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(kinds))])
        score = np.log(prior / (1 - prior))[kind]
        for j in range(cast.shape[1]):
            up = [(m[cast[:, j] > 0].sum() + s) / (m[cast[:, j] != 0].sum() + 10) for m, s in zip(mass, (2, 8), strict=True)]  # a labeler is thought better than chance
            score = score + np.where(cast[:, j] > 0, np.log(up[1] / up[0]), np.where(cast[:, j] < 0, np.log((1 - up[1]) / (1 - up[0])), 0.0))
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return dict(zip(keys, map(float, p), strict=True))


class SpanClassifier:
    """Log odds of hashed binary features, from how often each is expected to occur in spans of either truth."""

    def fit(self, rows: list[list[int]], target: np.ndarray) -> SpanClassifier:
        """From rows of features and their posteriors."""
        have = np.zeros((len(rows), WIDTH))
        for k, r in enumerate(rows):
            have[k, r] = 1
        return self.of_counts(np.ones(len(rows)), have, np.asarray(target, float))

    def of_counts(self, n: np.ndarray, have: np.ndarray, posterior: np.ndarray) -> SpanClassifier:
        """From groups of candidates: how many there are, how many have each feature, and their common posterior."""
        true, false = posterior @ have, (1 - posterior) @ have
        n_true, n_false = posterior @ n, (1 - posterior) @ n
        self.w = np.log((true + 1) / (n_true + 2)) - np.log((false + 1) / (n_false + 2))
        self.b = float(np.log((n_true + 1) / (n_false + 1)))
        return self

    def probability(self, row: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.w[row].sum() + self.b, -30, 30))))


def train(docs: DataFrame) -> SpanClassifier | None:
    """Reliabilities from the vote patterns of all candidates, then a classifier on all of them.

    Candidates are counted by kind, votes and feature where they are found;
    the driver gets those counts alone.
    """

    def run(texts: list, other: list) -> pa.RecordBatch:
        counts: Counter = Counter()
        for text in texts:
            for c in candidates(text or ""):
                cast = votes(text, c)
                counts.update((c.kind, cast, f) for f in (-1, *features(text, c)))  # -1 counts the candidate itself
        kinds, casts, numbers = zip(*counts, strict=True) if counts else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(casts, pa.string()), pa.array(numbers, pa.int32()), pa.array(counts.values(), pa.int64())], ["kind", "votes", "feature", "n"])

    found = map_texts(ordered_documents(docs).select("text"), run, "kind string, votes string, feature int, n long")
    rows = found.groupBy("kind", "votes", "feature").agg(F.sum("n").alias("n")).collect()  # at most kinds x 3^5 x WIDTH rows
    patterns = {(r["kind"], r["votes"]): r["n"] for r in rows if r["feature"] < 0}
    if not patterns:
        return None
    patterns = dict(sorted(patterns.items()))
    posterior, place = reliabilities(patterns), {k: i for i, k in enumerate(patterns)}
    have = np.zeros((len(patterns), WIDTH))
    for r in rows:
        if r["feature"] >= 0:
            have[place[r["kind"], r["votes"]], r["feature"]] = r["n"]
    return SpanClassifier().of_counts(np.array(list(patterns.values()), float), have, np.array([posterior[k] for k in patterns]))


def spans(text: str | None, model: SpanClassifier | None) -> list[tuple[str, int, int]]:
    """All spans by kind as listed, then start."""
    text = text or ""
    found = candidates(text)
    kept = [c for c in found if c.fixed]
    loose = [c for c in found if not c.fixed]
    if model is not None and loose:
        taken = sorted((c.start, c.end) for c in kept)
        starts = np.array([a for a, _ in taken], np.int64)
        reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else np.zeros(0, np.int64)
        last = -1
        for c in sorted(loose, key=lambda c: (c.start, -c.end, KINDS.index(c.kind))):
            k = int(np.searchsorted(starts, c.end)) - 1
            if c.start < last or (k >= 0 and reach[k] > c.start):
                continue
            if model.probability(features(text, c)) >= LEAST:
                kept.append(c if c.kind not in BASE else c._replace(kind=f"{c.kind}_loose"))
                last = c.end
    return sorted(((c.kind, c.start, c.end) for c in kept), key=lambda s: (KINDS.index(s[0]) if s[0] in KINDS else len(KINDS), s[0], s[1]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end) of every row."""
    model = train(docs)

    def run(texts: list, other: list) -> pa.RecordBatch:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t, model)] for t in texts]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([other[0], pa.array(found, kind)], ["doc_id", "spans"])

    return map_texts(ordered_documents(docs), run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed kinds, their spans' SHA-256 and all spans as text."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", *map(count, BASE),
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )
