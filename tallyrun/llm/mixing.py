"""Sources mixed to target shares of all tokens (problem 7).

Method: Poisson replication.  A document's hash, seeded, is its uniform number; the inverse of the Poisson distribution
function at that number, cut at the source's cap, is how often the document is used; the mean is chosen so that the
source reaches its share.  Documents are exploded by their counts and shuffled globally by a hash of document and copy.

Counts depend on the seed and the document alone, so a lost task repeats its draw and no state is kept.  One pass counts
tokens (broadcast vocabulary, whole texts) and keeps three small columns; the means are first solved for the expectation
and then set against the drawn totals themselves on a grid, so that a few very long documents do not shift a share.  The
global shuffle is a hash exchange with a sort in each partition: a random order without the sampling pass of a range
sort, and no partition can be hot.

Defined results: the total size is ``total_tokens``, by default all tokens of the sources that have a target; a source
that cannot reach its share within its cap is used ``max_repeats`` times throughout and reported as not met; sources
without target and documents without tokens are left out; a target without documents is reported with nothing reached;
equal documents under other ids are other documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrun.functions.ids import strip
from tallyrun.llm.spread import spread
from tallyrun.session import write_out

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are split before merging, as its publishers give it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED, GRID, ROUNDS, TOLERANCE = 20_240_601, 24, 2, 0.02
#: Most sources that are named in a filter, and most numbers of a grid that are broadcast; beyond these Spark joins.
MOST_SOURCES, MOST_STEPS = 10_000, 1_000_000


@lru_cache(2)
def _encoding(vocabulary: bytes):  # noqa: ANN202
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """The ``keep`` columns and ``n_tokens`` of each row's whole ``text``."""
    with open(tokenizer, "rb") as f:
        shared = texts.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(shared.value).encode_ordinary
        for b in batches:
            yield b[keep].assign(n_tokens=[len(encode(t)) if t else 0 for t in b["text"]])

    kinds = dict(texts.dtypes)
    return texts.select(*keep, "text").mapInPandas(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_tokens long"]))


def uniform(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1) from a seeded hash."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))


def poisson_steps(mean: float, cap: int) -> list[float]:
    """Distribution function at 0 .. cap - 1; a number above the k-th step stands for more than k uses."""
    if math.isinf(mean):
        return [-1.0] * cap
    if mean == 0:
        return [1.0] * cap
    steps, total, log_mean = [], 0.0, math.log(mean)
    for k in range(cap):
        total += math.exp(k * log_mean - mean - math.lgamma(k + 1))
        steps.append(min(1.0, total))
    return steps


def solve_mean(rate: float, cap: int) -> float:
    """Mean whose Poisson draws, cut at ``cap``, have the expectation ``rate``."""
    if rate <= 0:
        return 0.0
    if rate >= cap:
        return math.inf
    low, high = 0.0, max(1.0, rate)
    expect = lambda m: sum(1 - s for s in poisson_steps(m, cap))
    while expect(high) < rate:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if expect(mid) < rate else (low, mid)
    return (low + high) / 2


def uses(number: Column, steps: Column) -> Column:
    """The inverse: how many steps lie below the number."""
    return F.size(F.filter(steps, lambda s: s < number))


def _name(source: Column | str) -> Column:
    return F.lower(strip(source))


class Mixture:
    """A plan for one corpus: the sources' means, the mixed documents and the report."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = SEED) -> None:
        self.spark, self.seed = documents.sparkSession, seed
        rows = targets.select(_name("source").alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")
        rows = rows.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()
        self.targets = {r["source"]: (float(r["share"]), int(r["cap"])) for r in rows}
        named = documents.select("doc_id", _name("source").alias("source"), "text")
        if len(self.targets) <= MOST_SOURCES:
            named = named.filter(F.col("source").isin(*self.targets))
        else:
            named = named.join(write_out(self.spark.createDataFrame([(s,) for s in self.targets], "source string"), "targets"), "source", "left_semi")
        self.documents = named.filter(F.length("text") > 0)
        counted = token_counts(spread(self.documents, "doc_id"), ["doc_id", "source"], tokenizer)
        drawn = counted.filter("n_tokens > 0").select("source", "n_tokens", uniform(seed, "doc_id").alias("u"))
        self.drawn = write_out(drawn, "tokens")
        self.available = {r["source"]: (r["t"], r["n"]) for r in self.drawn.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
        self.total = total_tokens if total_tokens is not None else sum(t for t, _ in self.available.values())
        self.means = self._settle()

    def _grid(self, means: dict[str, list[float]]) -> DataFrame:
        rows = [(s, i, poisson_steps(m, self.targets[s][1])) for s, ms in means.items() for i, m in enumerate(ms)]
        grid = self.spark.createDataFrame(rows, "source string, i int, steps array<double>")
        return F.broadcast(grid) if sum(len(r[2]) for r in rows) <= MOST_STEPS else write_out(grid, "grid")

    def _totals(self, means: dict[str, list[float]]) -> dict[tuple[str, int], tuple[int, int, int]]:
        tries = self.drawn.join(self._grid(means), "source").select("source", "i", "n_tokens", uses(F.col("u"), F.col("steps")).alias("k"))
        sums = tries.groupBy("source", "i").agg(F.sum(F.col("k") * F.col("n_tokens")).alias("t"), F.sum("k").alias("c"), F.count_if(F.col("k") > 0).alias("d"))
        return {(r["source"], r["i"]): (r["t"], r["c"], r["d"]) for r in sums.collect()}

    def _settle(self) -> dict[str, float]:
        means = {s: solve_mean(self.targets[s][0] * self.total / t, self.targets[s][1]) for s, (t, _) in self.available.items()}
        width = 0.5
        for _ in range(ROUNDS):
            grid = {s: [m] if math.isinf(m) or m == 0 else [m * (1 + width) ** (2 * i / GRID - 1) for i in range(GRID + 1)] for s, m in means.items()}
            totals = self._totals(grid)
            for s, ms in grid.items():
                wanted = self.targets[s][0] * self.total
                means[s] = min(enumerate(ms), key=lambda e: (abs(totals[s, e[0]][0] - wanted), abs(e[0] - len(ms) // 2)))[1]
            width *= 3 / GRID
        return means

    def mixed(self) -> DataFrame:
        """Columns ``doc_id, source, copy_no, text`` in a global random order."""
        steps = self._grid({s: [m] for s, m in self.means.items()})
        used = self.documents.join(steps, "source").select("doc_id", "source", "text", uses(uniform(self.seed, "doc_id"), F.col("steps")).alias("k")).filter("k > 0")
        copies = used.select("doc_id", "source", F.explode(F.sequence(F.lit(1), "k")).alias("copy_no"), "text")
        place = F.xxhash64(F.lit(self.seed + 1), "doc_id", "copy_no")
        copies = copies.withColumn("_place", place)
        return copies.repartition("_place").sortWithinPartitions("_place").drop("_place")

    def report(self) -> DataFrame:
        """One row per source with a target: what was wanted, what it has, what it reached, and whether that is met."""
        totals = self._totals({s: [m] for s, m in self.means.items()})
        reached = {s: totals[s, 0] for s in self.means}
        every = sum(t for t, _, _ in reached.values())
        rows = []
        for s, (share, cap) in sorted(self.targets.items()):
            (tokens, docs), (got, copies, used) = self.available.get(s, (0, 0)), reached.get(s, (0, 0, 0))
            wanted = share * self.total
            rows.append((s, share, cap, docs, tokens, float(wanted), used, copies, got, got / every if every else 0.0, got / self.total if self.total else 0.0, abs(got - wanted) <= TOLERANCE * wanted))
        schema = "source string, target_share double, max_repeats int, documents long, available_tokens long, wanted_tokens double, used_documents long, copies long, reached_tokens long, reached_share double, share_of_total double, met boolean"
        return self.spark.createDataFrame(rows, schema)
