"""Abusive, hateful or sexually explicit passages (problem 8).

Method: every word and phrase has a log-odds score, abuse against ordinary text, with Dirichlet priors; a linear-time scan
finds all maximum-scoring segments of a text; extreme-value statistics say which are significant, and how much all of
them together mean.

*Priors* are a short list of seed words in four languages (``abuse_terms.py``), each with the share of its uses that is
abuse.  *Evidence* comes from the judged samples and from the whole corpus, by the company that words keep: texts that
hold one abusive passage hold another far more often than texts like them (same source, language and length), so a
phrase whose texts are abusive elsewhere (``FAR`` words away) at that higher rate is abusive, and one whose texts are no
worse than others is not.  This gives three kinds of features:

* seeds, whose share is the posterior of the prior ``Beta(WEIGHT * share, WEIGHT * (1 - share))``;
* contexts of seeds (two to four words with a seed in them), which start from their seed's prior: so harmless uses are
  learnt ("absolutely filthy finish");
* phrases of ``PHRASE`` words without any seed, abusive or not as a whole, with prior log-odds ``UNLIKELY``.

Shares become log-odds with Dirichlet smoothing; words that report or punish (``report_words``) lower the seeds of their
sentence unless someone is addressed just before.  Spelling is undone before all that: damaged encoding, markup,
look-alike letters, spaced-out and starred words, digits for letters, drawn-out and swapped letters.

*Calibration*: among ``n`` ordinary words, segments exceed ``s`` about ``K n exp(-lambda s)`` times; lambda and K follow
from the scores' shares among the corpus' ordinary words.  Every segment is held
against ``NEIGHBOURHOOD`` words, however long the text; those significant there are kept, and a sum statistic over the
best r of them, for the r that says most, gives how often such a neighbourhood would have them by chance.  A document's
score is minus the logarithm of that number: further passages never lower it, and length by itself changes nothing.

Texts are folded and spelt once and written to the shared folder; three light passes over the written words follow
(contexts and company, counts, scores).  What returns to the driver is bounded: rates per cell (``SOURCES`` x languages x
lengths), features above a share of the texts concerned (``CONTEXT_SHARE``, ``COMPANY_SHARE``), one row per feature.  The
judged samples are a bounded, documented input (``MOST_SAMPLES``).

Defined results: NULL and empty texts score 0 and are not flagged; whole texts are scanned, however long; copies of a text
score alike; without judged samples or in small corpora the seeds alone hold.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrun.llm.abuse_terms import explicit_words, report_words, seeds
from tallyrun.llm.spread import spread
from tallyrun.llm.text import plain
from tallyrun.session import write_out

Gram = tuple[str, ...]

MOST_SAMPLES = 50_000
#: Ordinary words per abusive word before any evidence, and the score of a word that is no feature.
ODDS, DRIFT = math.log(400), -0.5
#: How much a report word takes from the seeds of its sentence, up to how many words away, and who is addressed.
REPORTED, REACH, ADDRESSED = 5.0, 14, {"you", "your", "youre", "du", "dich", "tu", "te", "vous"}
ONESELF = {("i", "am"), ("i", "m"), ("i", "was"), ("ich", "bin"), ("ich", "war"), ("yo", "soy"), ("je", "suis")}
#: Words between a feature and the passage that counts as its company.
FAR = 20
#: Weight of a seed's prior; prior log-odds and lengths of learnt phrases; lengths of contexts; Dirichlet smoothing.
WEIGHT, UNLIKELY, PHRASE, CONTEXT, SMOOTH = 6.0, -9.0, (4, 5, 6), (2, 3, 4), 2.0
#: Least uses of a context, also as a share of the texts with seeds; least company, also as a share of all company.
LEAST_USES, CONTEXT_SHARE, COMPANY_SHARE = 5, 1e-3, 1e-4
#: Share of judgements that are wrong.
MISJUDGED = 0.05
#: Cells of texts alike: sources (by hash), languages and length classes.
SOURCES, LANGUAGES, LENGTHS = 64, ("en", "de", "es", "fr"), 8
#: A segment is significant, and its document flagged, when so many words of ordinary text have one at most this often;
#: passages that are company for others must be rarer.
EXPECTED, COMPANION, NEIGHBOURHOOD = 0.02, 0.01, 300
LATTICE = 0.5
EXPLICIT = explicit_words()
#: Shares of abusive uses at which likelihoods are taken.
GRID = np.array([0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 1.0])

LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"})
SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([ .\-_*]{1,2})(?:[^\W\d_]\1)+[^\W\d_](?![^\W_])")
TOKEN = re.compile(r"[.!?]+(?=[\s\"'”’)]|$)|\n|[^\W_]+(?:[*#@$!][*#@$!\w]*[^\W_])?|[$@][^\W_]+[^\s.,!?;:]*")
STARRED = re.compile(r"^[a-z]+[*#]{2,}[a-z]*$")
DRAWN = re.compile(r"(.)\1{2,}")
END, END_DRIFT = "\n", -2.0


class Speller:
    """Undoes disguised spellings of the terms' words; swapped letters only in ``strong`` words, as names come close."""

    def __init__(self, vocabulary: set[str], strong: set[str]) -> None:
        self.known = {w for w in vocabulary if len(w) > 2}
        self.swapped: dict[str, str] = {}
        for w in sorted(strong):
            if len(w) >= 5:
                for i in range(len(w) - 1):
                    s = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
                    if s not in self.known:
                        self.swapped.setdefault(s, w)
        self.glued = re.compile("|".join(sorted((w for w in strong if len(w) >= 6), key=lambda w: (-len(w), w))) or "(?!)")
        self.ends: dict[tuple[str, str, int], str] = {}
        for w in [*sorted(strong), *sorted(self.known)]:
            self.ends.setdefault((w[0], w[-1], len(w)), w)

    def word(self, w: str) -> str:
        if w in self.known:
            return w
        if STARRED.match(w):
            return self.ends.get((w[0], w[-1], len(w)), w)
        if not w.isalpha() and any(c.isalpha() for c in w):
            plainer = w.translate(LEET)
            w = plainer if plainer.isalpha() else w
            if w not in self.known and "g" in w and (t := w.replace("g", "q")) in self.known:
                w = t
        if w not in self.known and DRAWN.search(w):
            for to in (r"\1", r"\1\1"):
                if (t := DRAWN.sub(to, w)) in self.known:
                    return t
        if len(w) >= 12 and w.isalpha() and (m := self.glued.search(w)):
            return m.group()
        return self.swapped.get(w, w)

    def _joined(self, m: re.Match[str]) -> str:
        """Spaced-out letters as one word; an article before it stays apart."""
        w = re.sub(r"[ .\-_*]", "", m.group())
        return f"{w[0]} {w[1:]}" if w not in self.known and w[0] in "ai" and self.word(w[1:]) in self.known else w

    def tokens(self, text: str) -> list[str]:
        """The text's words, disguises undone, ``0`` for numbers, ``END`` for sentence ends."""
        t = SPACED.sub(self._joined, plain(text))
        return [END if not (w[0].isalnum() or w[0] in "$@") else "0" if w.isdigit() else self.word(w) for w in TOKEN.findall(t)]

def word_lists() -> tuple[set[str], set[str]]:
    """All words that the speller restores, and those it may restore from swapped letters and glued words."""
    prior = seeds()
    return {w for f in prior for w in f} | report_words(), {f[0] for f, s in prior.items() if len(f) == 1 and s > 0.9}


class Matcher:
    """Finds all given word sequences in folded words, by one automaton over the text."""

    def __init__(self, grams: Iterable[Gram]) -> None:
        self.grams = list(grams)
        self.machine = ahocorasick.Automaton()
        for i, g in enumerate(self.grams):
            self.machine.add_word(f" {' '.join(g)} ", (i, len(g)))
        if self.grams:
            self.machine.make_automaton()

    def find(self, words: str) -> Iterator[tuple[int, int, int]]:
        """``(number of the gram, its first word, its last word)``, by last word."""
        if not self.grams:
            return
        text, at, place = f" {words} ", 0, -1
        for end, (i, n) in self.machine.iter(text):
            place, at = place + text.count(" ", at, end), end
            yield i, place - n + 1, place


def sentence(tokens: Sequence[str], i: int) -> tuple[int, int]:
    """First and last word around a place up to a sentence end, ``REACH`` words either way at most."""
    a = b = i
    while a > 0 and i - a < REACH and tokens[a - 1] != END:
        a -= 1
    while b + 1 < len(tokens) and b - i < REACH and tokens[b + 1] != END:
        b += 1
    return a, b


def reported(tokens: Sequence[str], i: int, reports: set[str]) -> bool:
    """Whether the speaker speaks of oneself, or a report word stands in the sentence and nobody is addressed just before."""
    a, b = sentence(tokens, i)
    if tokens[i] not in EXPLICIT and any((tokens[k], tokens[k + 1]) in ONESELF for k in range(max(a, i - 4), i - 1)):
        return True
    return not reports.isdisjoint(tokens[a : b + 1]) and ADDRESSED.isdisjoint(tokens[max(a, i - 3) : i])


def maximal_segments(scores: Sequence[tuple[int, float]], drift: Sequence[float] | None = None) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(score, first, after last)`` of sparse scores, in linear time (Ruzzo and Tompa).

    ``scores`` are ``(place, score > 0)`` by place, ``drift`` the negative sums before each of them (since the one before).
    """
    kept: list[tuple[float, float, int, int]] = []  # sum before, sum through, first, after last
    total = 0.0
    for n, (i, s) in enumerate(scores):
        left = total + (drift[n] if drift else 0.0)
        right, first = left + s, i
        total = right
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= left:
                j -= 1
            if j < 0 or kept[j][1] >= right:
                kept.append((left, right, first, i + 1))
                break
            left, first = kept[j][0], kept[j][2]
            del kept[j:]
    return [(r - b, f, e) for b, r, f, e in kept]


def log_odds(share: float) -> float:
    """Score of a feature: log-odds of abuse among its uses against those of any word."""
    share = min(0.998, max(0.002, share))
    return math.log(share / (1 - share)) + ODDS


@dataclass
class Model:
    """Scores of seeds, of their contexts (longer ones count before shorter ones) and of phrases; the extreme-value law."""

    seeds: dict[Gram, float]
    contexts: dict[Gram, float] = field(default_factory=dict)
    phrases: dict[Gram, float] = field(default_factory=dict)
    decay: float = 1.0
    scale: float = 0.1
    _tools: tuple | None = field(default=None, repr=False)

    @property
    def tools(self) -> tuple[Speller, Matcher, list[tuple[int, float]], set[str]]:
        """Speller, matcher, kind and score of each of its features, report words; built once per process."""
        if self._tools is None:
            parts = (self.seeds, self.contexts, self.phrases)
            grams = [(g, kind, s) for kind, d in enumerate(parts) for g, s in d.items()]
            self._tools = (Speller(*word_lists()), Matcher(g for g, _, _ in grams), [(k, s) for _, k, s in grams], report_words())
        return self._tools

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_tools": None}

    def positive_scores(self, words: str) -> list[tuple[int, float]]:
        """``(place, score)`` of the words with positive scores.

        A seed has no force inside a harmless context; else it takes the score of the longest contexts that hold it, the
        least of them.  Phrases that overlap count once.
        """
        _, matcher, kinds, reports = self.tools
        hits: dict[int, tuple[float, int]] = {}
        contexts, phrases = [], []
        for i, a, b in matcher.find(words):
            kind, s = kinds[i]
            if kind == 0:
                hits[b] = max(hits.get(b, (-math.inf, 0)), (s, b - a))
            elif kind == 1:
                contexts.append((a, b, s))
            elif phrases and a <= phrases[-1][0]:
                phrases[-1] = (b, max(s, phrases[-1][1]))
            else:
                phrases.append((b, s))
        out: dict[int, float] = {}
        if hits:
            tokens, found, at = words.split(" "), {}, sorted(hits)
            for a, b, s in contexts:
                for p in range(a, b + 1):
                    if p in hits:
                        n, least = found.get(p, (0, 0.0))
                        if n == 0 or s <= 0 or least > 0 and (a - b, s) < (-n, least):
                            found[p] = b - a, s
            for p in at:
                s, extra = hits[p]
                s = found[p][1] if p in found and not extra else s
                if s > 0 and reported(tokens, p, reports):
                    s -= REPORTED
                if s > 0:
                    out[p] = s
        for p, s in phrases:
            out[p] = max(s, out.get(p, 0.0))
        return sorted(out.items())

    def segments(self, words: str) -> list[tuple[float, int, int]]:
        """All maximal segments of the folded words."""
        scores = self.positive_scores(words)
        if not scores:
            return []
        drift = [0.0]
        tokens = words.split(" ") if len(scores) > 1 else []
        for (i, _), (j, _) in zip(scores, scores[1:]):
            drift.append(DRIFT * (j - i - 1) + (END_DRIFT - DRIFT) * tokens[i + 1 : j].count(END))
        return maximal_segments(scores, drift)

    def strength(self, score: float) -> float:
        """Minus the logarithm of how often a neighbourhood of ordinary words has such a segment."""
        return self.decay * score - math.log(self.scale * NEIGHBOURHOOD)

    def significant(self, words: str, expected: float = EXPECTED) -> list[tuple[float, int, int]]:
        return [s for s in self.segments(words) if self.strength(s[0]) >= -math.log(expected)]

    def judge(self, words: str | None) -> tuple[float, float, str, list[str]]:
        """Score, expected number in ordinary text, best segment, and all significant segments in the text's order."""
        segments = self.segments(words) if words else []
        if not segments:
            return 0.0, float(NEIGHBOURHOOD), "", []
        best = max(segments)
        kept = [s for s in segments if self.strength(s[0]) >= -math.log(EXPECTED)]
        strengths = [self.strength(s[0]) for s in kept or [best]]
        log_expected = log_expected_sets(strengths) if kept else -strengths[0]
        tokens = words.split(" ")
        said = lambda s: " ".join(tokens[s[1] : s[2]]).replace(END, "/")
        return max(0.0, -log_expected), math.exp(min(log_expected, 600.0)), said(best), [said(s) for s in kept]


def log_erlang_tail(r: int, u: float) -> float:
    """Logarithm of ``exp(-u) * sum of u^k / k! over k < r``, summed from the largest term outwards."""
    if u <= 0:
        return 0.0
    top = min(r - 1, int(u))
    total = 1.0
    for step in (-1, 1):
        k, term = top, 1.0
        while term > 1e-14 * total and 0 <= k + step < r:
            term *= k / u if step < 0 else u / (k + 1)
            k += step
            total += term
    return min(0.0, top * math.log(u) - math.lgamma(top + 1) - u + math.log(total))


def log_expected_sets(strengths: Sequence[float]) -> float:
    """Logarithm of how often chance gives such significant segments, for the number r of best ones where it is rarest.

    ``strengths`` are ``lambda s - ln(K n)``, ``-ln EXPECTED`` at least.  By chance those are a Poisson process of
    intensity ``exp(-x)``, so sets of r with at least the sum T number ``EXPECTED^r / r!`` times the Erlang tail of T less
    r times the least strength (the sum statistic of Karlin and Altschul, over significant segments).
    """
    least, total, found = -math.log(EXPECTED), 0.0, math.inf
    for r, x in enumerate(sorted(strengths, reverse=True), 1):
        total += x
        found = min(found, -r * least - math.lgamma(r + 1) + log_erlang_tail(r, total - r * least))
    return found


def extreme_value_law(shares: dict[float, float]) -> tuple[float, float]:
    """Lambda and K of Karlin and Altschul for independent tokens with the given scores and shares (which add up to 1).

    Scores are taken on a lattice of multiples of ``LATTICE``; both constants are for scores in their own unit.
    """
    span = math.gcd(*[round(s / LATTICE) for s in shares]) or 1
    unit, steps = span * LATTICE, defaultdict(float)
    for s, share in shares.items():
        steps[round(s / unit)] += share
    steps = {k: v for k, v in steps.items() if v > 0}
    low, high = min(steps, default=0), max(steps, default=0)
    if high <= 0 or sum(k * v for k, v in steps.items()) >= 0:
        return 1.0, 1.0
    p = np.zeros(high - low + 1)
    for k, v in steps.items():
        p[k - low] += v
    at = np.arange(low, high + 1)
    a, b = 1e-6, (1e-6 - math.log(p[-1])) / high  # the highest score alone reaches one there
    for _ in range(100):
        m = (a + b) / 2
        a, b = (a, m) if float(p @ np.exp(m * at)) > 1 else (m, b)
    lam = (a + b) / 2
    entropy = lam * float((p * at) @ np.exp(lam * at))
    total, q, start = 0.0, np.ones(1), 0
    for k in range(1, 61):
        q, start = np.convolve(q, p), start + low
        sums = np.arange(start, start + len(q))
        total += (float(q[sums < 0] @ np.exp(lam * sums[sums < 0])) + float(q[sums >= 0].sum())) / k
    return lam / unit, math.exp(-2 * total) / (entropy / lam * -math.expm1(-lam))


def cell_of(source: str | None, lang: str | None, words: int) -> int:
    """Number of the cell of texts alike."""
    s = zlib.crc32((source or "").strip().lower().encode("utf-8", "replace")) % SOURCES
    short = (lang or "")[:2].lower()
    size = min(LENGTHS - 1, max(0, int(math.log2(max(1, words) / 10))))
    return (s * (len(LANGUAGES) + 1) + (LANGUAGES.index(short) + 1 if short in LANGUAGES else 0)) * LENGTHS + size


def company(passages: Sequence[int], first: int, last: int) -> bool:
    """Whether any passage (``first, last, first, last ...``, by place) lies ``FAR`` words away from the given words."""
    return len(passages) > 0 and (passages[1] < first - FAR or passages[-2] > last + FAR)


def grams_of(tokens: Sequence[str], sizes: Sequence[int]) -> Iterator[tuple[int, int, Gram]]:
    """Word sequences within sentences: first word, last word, words."""
    for i in range(len(tokens)):
        for k in range(1, sizes[-1] + 1):
            if i + k > len(tokens) or tokens[i + k - 1] == END:
                break
            if k >= sizes[0]:
                yield i, i + k - 1, tuple(tokens[i : i + k])


def contexts_of(tokens: Sequence[str], single: set[str]) -> set[Gram]:
    """Word sequences around single-word seeds, within sentences."""
    out = set()
    for p, w in enumerate(tokens):
        if w in single:
            a = max(0, p - CONTEXT[-1] + 1)
            out.update(g for i, j, g in grams_of(tokens[a : p + CONTEXT[-1]], CONTEXT) if a + i <= p <= a + j)
    return out


def fold(documents: DataFrame, model: Model) -> DataFrame:
    """Written table ``doc_id, source, words, cell, seeded, passages`` of all documents; passages by the seeds alone."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    texts = spread(documents.select("doc_id", "source", "text", lang.alias("lang")), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        speller, matcher, *_ = model.tools
        for b in batches:
            words = [" ".join(speller.tokens(t)) if t else "" for t in b["text"]]
            passages = [[x for _, f, e in model.significant(w, COMPANION) for x in (f, e - 1)] for w in words]
            cells = [cell_of(s, g, w.count(" ") + 1) for s, g, w in zip(b["source"], b["lang"], words)]
            seeded = [next(matcher.find(w), None) is not None for w in words]
            yield b[["doc_id", "source"]].assign(words=words, cell=cells, seeded=seeded, passages=passages)

    return write_out(texts.mapInPandas(run, "doc_id long, source string, words string, cell int, seeded boolean, passages array<int>"), "folded")


@dataclass
class Rates:
    """Per cell: the share of texts with a passage, and of passages with another one far away; over all: texts, shares."""

    plain: dict[int, float]
    paired: dict[int, float]
    texts: int
    share: float

    def likelihoods(self, cell: int, accompanied: bool) -> np.ndarray:
        """Log-likelihood of a text's company at the shares of ``GRID``, against no abuse."""
        p, q = self.plain[cell], self.paired[cell]
        p, q = (p, q) if accompanied else (1 - p, 1 - q)
        return np.log(GRID * q + (1 - GRID) * p) - math.log(p)


def rates(folded: DataFrame) -> Rates:
    """Rates per cell, smoothed towards the overall share and, for pairs, towards no difference."""
    passages = F.size("passages") / 2
    far = F.expr(f"size(filter(sequence(0, cast(size(passages) / 2 as int) - 1), i -> passages[1] < passages[2 * i] - {FAR} or passages[size(passages) - 2] > passages[2 * i + 1] + {FAR}))")
    some = F.size("passages") > 0
    rows = folded.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(some).alias("y"), F.sum(F.when(some, passages)).alias("all"), F.sum(F.when(some, far)).alias("far")).collect()
    n, y = sum(r["n"] for r in rows), sum(r["y"] for r in rows)
    share = min(0.5, (y + 0.5) / (n + 100))
    plain = {r["cell"]: min(0.9, (r["y"] + 5 * share) / (r["n"] + 5)) for r in rows}
    paired = {c: min(0.95, max(plain[c], ((r["far"] or 0) + 10 * plain[c]) / ((r["all"] or 0) + 10))) for r in rows for c in [r["cell"]]}
    return Rates(plain, paired, n, share)


def candidates(folded: DataFrame, known: Rates) -> tuple[set[Gram], set[Gram]]:
    """Contexts of seeds and phrases in abusive company that are common enough to be learnt."""
    shared = folded.sparkSession.sparkContext.broadcast(known)
    prior = seeds()
    single = {f[0] for f in prior if len(f) == 1}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for b in batches:
            uses, weights, total = Counter(), Counter(), 0.0
            for words, cell, passages in zip(b["words"], b["cell"], b["passages"]):
                tokens = words.split(" ")
                uses.update(contexts_of(tokens, single))
                weight = math.log(known.paired[cell] / known.plain[cell])
                if len(passages) and weight > 0:
                    total += weight
                    for g in {g for i, j, g in grams_of(tokens, PHRASE) if company(passages, i, j)}:
                        weights[g] += weight
            rows = [(" ".join(g), 0.0, n) for g, n in uses.items()] + [(" ".join(g), w, 0) for g, w in weights.items()] + [("", total, len(b))]
            yield pd.DataFrame(rows, columns=["gram", "weight", "uses"])

    summed = folded.filter("seeded").select("words", "cell", "passages").mapInPandas(run, "gram string, weight double, uses long").groupBy("gram").agg(F.sum("weight").alias("weight"), F.sum("uses").alias("uses"))
    summed = write_out(summed, "grams")
    total = summed.filter("gram = ''").first()
    if total is None:
        return set(), set()
    least = max(LEAST_USES, CONTEXT_SHARE * total["uses"]), max(-UNLIKELY, COMPANY_SHARE * total["weight"])
    rows = summed.filter((F.col("gram") != "") & ((F.col("uses") >= least[0]) | (F.col("weight") >= least[1]))).collect()
    split = [(tuple(r["gram"].split(" ")), r) for r in rows]
    return {g for g, r in split if r["uses"] >= least[0]}, {g for g, r in split if r["weight"] >= least[1] and single.isdisjoint(g)}


def corpus_evidence(folded: DataFrame, known: Rates, grams: Sequence[Gram]) -> dict[Gram, tuple[int, np.ndarray]]:
    """Texts with each feature, and the log-likelihoods of their company at the shares of ``GRID``."""
    shared = folded.sparkSession.sparkContext.broadcast((known, list(grams)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, grams = shared.value
        matcher, seen = Matcher(grams), Counter()
        for b in batches:
            for words, cell, passages in zip(b["words"], b["cell"], b["passages"]):
                found: dict[int, bool] = {}
                for i, f, e in matcher.find(words):
                    found[i] = found.get(i, False) or company(passages, f, e)
                seen.update((i, cell, y) for i, y in found.items())
        sums: dict[int, np.ndarray] = {}
        for (i, cell, y), n in seen.items():
            row = sums.setdefault(i, np.zeros(len(GRID) + 1))
            row[0] += n
            row[1:] += n * known.likelihoods(cell, y)
        yield pd.DataFrame([(i, *row) for i, row in sums.items()], columns=["gram", "uses", *(f"l{k}" for k in range(len(GRID)))])

    schema = "gram int, uses double, " + ", ".join(f"l{k} double" for k in range(len(GRID)))
    columns = ["uses", *(f"l{k}" for k in range(len(GRID)))]
    rows = folded.select("words", "cell", "passages").mapInPandas(run, schema).groupBy("gram").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    return {grams[r["gram"]]: (int(r["uses"]), np.array(r[2:])) for r in rows}


def judged_grams(samples: Sequence[tuple[str, int]], speller: Speller, wanted: set[Gram]) -> tuple[dict[Gram, tuple[int, int]], int]:
    """Flagged and unflagged samples with each wanted feature, or with phrases of two flagged samples; flagged samples."""
    bad, good, flagged = Counter(), Counter(), 0
    for text, judgement in samples:
        tokens = speller.tokens(text)
        seen = {g for _, _, g in grams_of(tokens, tuple(range(1, PHRASE[-1] + 1)))}
        (bad if judgement else good).update(seen)
        flagged += bool(judgement)
    single = {f[0] for f in seeds() if len(f) == 1}
    kept = wanted | {g for g, n in bad.items() if n >= 2 and len(g) in PHRASE and single.isdisjoint(g)}
    return {g: (bad[g], good[g]) for g in kept if bad[g] or good[g]}, flagged


def posterior_share(share: float, likelihoods: np.ndarray, bad: int, good: int) -> float:
    """Mean share of abusive uses of a seed or context, given its prior share, its company and the judgements."""
    t, width = np.clip(GRID, 0.01, 0.99), np.gradient(GRID)
    width[[0, -1]] /= 2
    log_p = (WEIGHT * share - 1) * np.log(t) + (WEIGHT * (1 - share) - 1) * np.log(1 - t) + np.log(width) + likelihoods
    log_p += bad * np.log(t + (1 - t) / 3) + good * np.log(t * MISJUDGED + (1 - t))
    p = np.exp(log_p - log_p.max())
    return float(p @ GRID / p.sum())


def phrase_log_odds(uses: int, likelihoods: np.ndarray, bad: int, good: int, flagged: int, known: Rates) -> float:
    """Posterior log-odds that a phrase is abuse wherever it is used.

    Judged samples: if it were, its share among flagged samples would be the corpus' share of texts with it, times one in
    the share of abusive texts; otherwise the corpus' share itself.
    """
    out = UNLIKELY + float(likelihoods[-2])
    if bad or good:
        among = min(1.0, uses / max(1, known.texts))
        out += bad * math.log(1 / known.share) - flagged * among * (1 / known.share - 1) + good * math.log(2 * MISJUDGED)
    return out


def fit(folded: DataFrame, samples: Sequence[tuple[str, int]]) -> Model:
    """The model of the corpus and the judged samples."""
    prior = seeds()
    known = rates(folded)
    contexts, phrases = candidates(folded, known)
    judged, flagged = judged_grams(samples, Speller(*word_lists()), {*prior, *contexts, *phrases})
    phrases = (phrases | {g for g in judged if len(g) in PHRASE}) - contexts - set(prior)
    evidence = corpus_evidence(folded, known, sorted({*prior, *contexts, *phrases}))
    nothing = (0, np.zeros(len(GRID)))
    model, uses, shares = Model({}), {}, {}
    for g, share in prior.items():
        n, like = evidence.get(g, nothing)
        after = posterior_share(share, like, *judged.get(g, (0, 0)))
        uses[g], shares[g] = n, after
        # outside the known contexts the seed stands between what was known of it and what the common contexts say
        model.seeds[g] = (log_odds(share) + log_odds(after)) / 2
    for g in contexts:
        share = max(prior.get((w,), 0.0) for w in g)
        n, like = evidence.get(g, nothing)
        after = posterior_share(share, like, *judged.get(g, (0, 0)))
        uses[g], shares[g] = n, after
        model.contexts[g] = log_odds(after) if after >= share / 2 else 0.0
    for g in phrases:
        n, like = evidence.get(g, nothing)
        odds = phrase_log_odds(n, like, *judged.get(g, (0, 0)), flagged, known)
        if n and odds > 0:
            shares[g] = (n / (1 + math.exp(-min(odds, 30.0))) + SMOOTH / 2) / (n + SMOOTH)
            uses[g], model.phrases[g] = n, log_odds(shares[g])
    words, ends = folded.agg(F.sum(F.size(F.split("words", " "))), F.sum(F.size(F.split("words", END)) - 1)).first()
    return calibrated(model, uses, shares, words or 0, ends or 0)


def calibrated(model: Model, uses: dict[Gram, int], shares: dict[Gram, float], words: int, ends: int) -> Model:
    """The model with the extreme-value law of the scores among the corpus' ordinary words.

    A feature's ordinary uses are those that its company shows beyond what its prior allows (uses times the fall of the
    abusive share); those of a seed inside contexts of two words are the contexts' own (by the neighbour before or after,
    whichever explains more).  All scores have besides the share that log-odds promise, ``exp(-score)``.
    """
    prior = seeds()
    before = {g: prior.get(g) or max((prior.get((w,), 0.0) for w in g), default=0.0) or shares.get(g, 0.0) for g in {**model.seeds, **model.contexts, **model.phrases}}
    ordinary = {g: uses.get(g, 0) * max(0.0, s - shares.get(g, s)) for g, s in before.items()}
    inside: dict[tuple[Gram, int], float] = defaultdict(float)
    for g in model.contexts:
        if len(g) == 2:
            inside[g[1:], 0] += ordinary[g]
            inside[g[:1], 1] += ordinary[g]
    total, among = max(1, words), defaultdict(float)
    for g, s in [*model.seeds.items(), *model.phrases.items(), *((g, s) for g, s in model.contexts.items() if len(g) == 2)]:
        if s > 0:
            n = ordinary[g] - (max(inside[g, 0], inside[g, 1]) if g in model.seeds else 0.0)
            among[s] += max(0.0, n) / total + math.exp(-s) / max(1, len(ordinary))
    among[END_DRIFT] += ends / total
    among[DRIFT] += max(0.5, 1 - sum(among.values()))
    whole = sum(among.values())
    model.decay, model.scale = extreme_value_law({s: n / whole for s, n in among.items()})
    return model


def seed_model() -> Model:
    """The seeds alone, by their priors."""
    return Model({g: log_odds(share) for g, share in seeds().items()})


def score_documents(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """Columns ``doc_id, source, score, expected, segment, segments, flagged`` for every document.

    ``expected`` is how often ``NEIGHBOURHOOD`` words of ordinary text have such segments; ``score`` is minus its
    logarithm, 0 at least; ``segment`` are the words of the best segment, ``segments`` those of all significant ones.
    """
    judged = samples.filter("text IS NOT NULL AND flagged IS NOT NULL").select("text", "flagged").orderBy("sample_id").limit(MOST_SAMPLES).collect()
    folded = fold(documents, seed_model())
    shared = documents.sparkSession.sparkContext.broadcast(fit(folded, [(r["text"], int(r["flagged"])) for r in judged]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in batches:
            rows = [model.judge(t) for t in b["words"]]
            yield b[["doc_id", "source"]].assign(score=[r[0] for r in rows], expected=[r[1] for r in rows], segment=[r[2] for r in rows], segments=[r[3] for r in rows], flagged=[bool(r[3]) for r in rows])

    return folded.select("doc_id", "source", "words").mapInPandas(run, "doc_id long, source string, score double, expected double, segment string, segments array<string>, flagged boolean")
