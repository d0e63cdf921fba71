"""Freely typed values to the entries of a reference list (problem 1).

Method: a symmetric-delete dictionary.  Every name of the list is stored under all strings that come from it by deleting
up to ``bound(length)`` letters; a value looks up its own deletions, so that only names within the bounded edit distance
are met.  They are ranked by a weighted Damerau-Levenshtein distance (a letter doubled, swapped or hit on a neighbouring
key costs less), then by how often the entry is written correctly in the data.  Values that meet nothing are reported
with ``list_id`` -1.

Only distinct values are looked up.  The list is broadcast in blocks of about ``BLOCK`` entries, so the broadcast has a
bound whatever the list's length.  Each block returns its best match with its full rank, and the first in rank over all
blocks holds: the same as one block would give.

Defined results: NULL and blank values map to nothing and are not reported; of several entries named in a value the
first one counts; equal ranks go to the more frequent entry, then the smaller id; an empty list leaves every value
unmatched; very long values are looked up like others.  Letters are deleted from the first ``PREFIX`` letters only, which
loses nothing: within ``k`` edits, the prefixes of both have a common form after ``k`` deletions each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrun.llm.text import plain

BLOCK, PREFIX = 20_000, 20
#: The id of values that mean no entry.
MISS = -1
#: A match's rank, least first: reading (of the country named first; the whole value, if only nearly met, last), way to
#: write it (``NEAR`` behind all exact ones), weighted distance, minus the entry's frequency, its id.
Rank = tuple[int, int, float, int, int]
RANK, NEAR = ("reading", "way", "distance", "rarity", "list_id"), 2**31 - 1
NO_RANK: Rank = (0, 0, 0.0, 0, MISS)

# Digits and signs written for letters, and the rows of a keyboard.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"})
KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
# Words before or after a country that say how it is meant, endings that name its people, and short forms of words in country names.
LEAD = re.compile(r"^(?:(?:a |the )?(?:citizen|native|national|resident|subject) of|from|born in|nationality|country|rep\.? team of|national team of|team of|formerly|ex|now|prob(?:ably|\.)?|ca\.?)[\s:]+")
TRAIL = re.compile(r"\s*(?:\[\d+\]|[-–,]?\s*(?:naturali[sz]ed|by (?:birth|descent|marriage)|since \d{2,4}|until \d{2,4}|\(?(?:birth|born|by descent|passport|dual|naturali[sz]ed|citizen|current|former)\)?))\s*$")
SHORT_FORMS = {"dem": "democratic", "rep": "republic", "repub": "republic", "kgdm": "kingdom", "kdm": "kingdom", "king": "kingdom", "st": "saint", "n": "north", "s": "south", "no": "north", "so": "south", "is": "islands", "isl": "islands", "terr": "territories", "emir": "emirates", "utd": "united", "un": "united", "fed": "federation"}
DEMONYM = re.compile(r"(?:ese|ian|ish|er|an|n|i)$")
SEPARATORS = re.compile(r"[;/|+&]| - (?=[^\W\d_]+(?: \w+){0,3}$)")


def bound(length: int) -> int:
    """Deletions allowed for a name or value of this many letters."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 24 else 3


def fold(value: str) -> str:
    """Folded value: letters only a reader would see, single spaces."""
    t = plain(value.replace("\xa0", " ").replace("_", " "))
    t = " ".join(w.translate(LEET) if re.search(r"[a-z]", w) and re.search(r"[0-9@$]", w) else w for w in t.split())
    return t.strip(" .,*'\"`´?!:;-–—†#")


def letters(value: str) -> str:
    """Only letters and digits, in words."""
    return " ".join(re.findall(r"[^\W_]+", value))


def readings(value: str) -> list[list[str]]:
    """Ways to read a value: per country named, in order, its possible names (best first)."""
    whole = fold(value)
    parts = [p for p in (fold(x) for x in SEPARATORS.split(whole)) if p]
    out: list[list[str]] = [[letters(whole), letters(whole).replace(" ", "")]]
    if " - " in whole:
        a, b = whole.split(" - ", 1)
        out[0].append(letters(f"{b} {a}"))
    if "&" in whole:
        parts.insert(0, whole.replace("&", " and "))
    for p in parts or [whole]:
        ways = [p]
        bare = TRAIL.sub("", re.sub(r"\s*\([^)]*\)?\s*$", "", p) or p)
        for _ in range(2):
            bare = LEAD.sub("", TRAIL.sub("", bare)).strip()
        ways.append(bare)
        if m := re.match(r"^(.*?)\s*\(([^)]*)\)?$", p):
            ways += [f"{m[2]} {m[1]}", m[2]]
        if "," in bare:
            bits = [x.strip() for x in bare.split(",") if x.strip()]
            ways += [" ".join([*bits[1:], bits[0]]), *reversed(bits)]
        if m := re.match(r"^(.+) and (.+)$", bare):
            ways.append(f"{m[2]} and {m[1]}")
        long = [" ".join(SHORT_FORMS.get(w, w) for w in letters(w).split()) for w in ways]
        long += [DEMONYM.sub("", letters(bare))]
        out.append(list(dict.fromkeys(x for x in [*map(letters, ways), *long] if x)))
    return out


def deletions(word: str, most: int) -> set[str]:
    """The word's prefix with up to ``most`` letters left out."""
    found = edge = {word[:PREFIX]}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        found = found | edge
    return found


@lru_cache(1)
def _neighbours() -> frozenset[tuple[str, str]]:
    near = {(r[i], r[i + 1]) for r in KEY_ROWS for i in range(len(r) - 1)}
    near |= {(a[i], b[j]) for a, b in zip(KEY_ROWS, KEY_ROWS[1:], strict=False) for i in range(len(a)) for j in (i - 1, i) if 0 <= j < len(b)}
    return frozenset(near | {(y, x) for x, y in near})


def distance(a: str, b: str, most: int) -> tuple[int, float] | None:
    """Damerau-Levenshtein distance (plain, weighted), None beyond ``most`` plain edits."""
    if abs(len(a) - len(b)) > most:
        return None
    near = _neighbours()
    rows = [[(j, float(j)) for j in range(len(b) + 1)]]
    for i in range(1, len(a) + 1):
        row = [(i, float(i))]
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            sub = 0.0 if x == y else 0.7 if (x, y) in near else 1.1
            up, left, diagonal = rows[i - 1][j], row[j - 1], rows[i - 1][j - 1]
            doubled_a = 0.6 if i > 1 and a[i - 2] == x else 1.0
            doubled_b = 0.6 if j > 1 and b[j - 2] == y else 1.0
            best = min((up[0] + 1, up[1] + doubled_a), (left[0] + 1, left[1] + doubled_b), (diagonal[0] + (x != y), diagonal[1] + sub))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y:
                best = min(best, (rows[i - 2][j - 2][0] + 1, rows[i - 2][j - 2][1] + 0.8))
            row.append(best)
        if min(r[0] for r in row) > most:
            return None
        rows.append(row)
    return rows[-1][-1] if rows[-1][-1][0] <= most else None


class SymmetricDelete:
    """The dictionary: names, short codes, and the deletions of the names."""

    def __init__(self, entries: Sequence[tuple[int, str, str | None, str | None, int]]) -> None:
        self.exact: dict[str, int] = {}
        self.codes: dict[str, int] = {}
        self.weight: dict[int, int] = {}
        self.deleted: dict[str, list[str]] = {}
        for list_id, name, others, code, weight in sorted(entries, key=lambda e: (-e[4], e[0], e[1] or "")):  # of entries that share a name
            self.weight[list_id] = weight
            for n in [name, *(others or "").split("; ")]:
                if key := letters(fold(n)) if n else "":
                    self.exact.setdefault(key, list_id)
            if code and (key := letters(fold(code)).replace(" ", "")):
                self.codes.setdefault(key, list_id)
        self.longest = max(map(len, self.exact), default=0)
        for key in self.exact:
            for d in deletions(key, bound(len(key))):
                self.deleted.setdefault(d, []).append(key)

    def near(self, value: str) -> tuple[float, int, int] | None:
        """Best entry within the bound: weighted distance, minus its frequency, its id."""
        most = bound(len(value))
        if len(value) > self.longest + most:
            return None
        names = {n for d in deletions(value, most) for n in self.deleted.get(d, ())}
        ranked = [(w[1], -self.weight[self.exact[n]], self.exact[n]) for n in names if (w := distance(value, n, min(most, bound(len(n)))))]
        return min(ranked, default=None)

    def look_up(self, value: str) -> tuple[int, float]:
        """Entry and weighted distance of a value, ``MISS`` if it names none."""
        best = self.ranked(value)
        return (best[-1], best[2]) if best else (MISS, 0.0)

    def ranked(self, value: str) -> Rank | None:
        """Best entry of a value with its rank, which is comparable between the blocks of a list; None if it names none."""
        ways = readings(value)
        for reading, group in enumerate(ways):
            for k, way in enumerate(group):
                if way in self.exact:
                    return reading, 2 * k, 0.0, -self.weight[self.exact[way]], self.exact[way]
                if (code := way.replace(" ", "")) in self.codes and len(code) <= 6:
                    return reading, 2 * k + 1, 0.0, -self.weight[self.codes[code]], self.codes[code]
            if reading and (best := min((b for way in group if (b := self.near(way))), default=None)):
                return reading, NEAR, *best
        if best := min((b for way in ways[0] if (b := self.near(way))), default=None):
            return len(ways), NEAR, *best
        return None


def map_to_list(values: DataFrame, entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Columns ``value, list_id, distance`` for every distinct value.

    ``values`` has ``value`` and ``n`` (rows that have it); ``entries`` has the list's columns of TESTDATA.md.
    """
    spark = values.sparkSession
    exact = values.groupBy("value").agg(F.sum("n").alias("n"))
    entries = entries.select("list_id", "canonical_name", "other_names", "short_code")
    weighted = entries.join(exact, entries["canonical_name"] == exact["value"], "left").select("list_id", "canonical_name", "other_names", "short_code", F.coalesce("n", F.lit(0)).alias("weight"))
    blocks = max(1, -(-entries.count() // block))
    distinct = exact.select("value")
    out = None
    for b in range(blocks):
        rows = [tuple(r) for r in weighted.filter(F.pmod(F.xxhash64("list_id"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            index = SymmetricDelete(shared.value)
            for batch in batches:
                found = [index.ranked(v) or NO_RANK for v in batch["value"]]
                yield pd.DataFrame([(v, *f) for v, f in zip(batch["value"], found, strict=True)], columns=["value", *RANK])

        one = distinct.mapInPandas(run, "value string, reading int, way int, distance double, rarity long, list_id int")
        out = one if out is None else out.unionByName(one)
    if blocks > 1:
        rank = F.struct((F.col("list_id") == MISS).alias("miss"), *RANK)
        out = out.groupBy("value").agg(F.min(rank).alias("r")).select("value", "r.list_id", "r.distance")
    return out.select("value", "list_id", "distance")
