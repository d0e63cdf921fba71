"""Documents that carry held-out test items (problem 6).

Method: the test items become a BM25 inverted index with block maxima.  Every document is a query against it, answered by
block-max WAND, which skips whatever cannot reach the threshold and returns every item above it.  The threshold of an
item is a lower bound of the score of any text that verification would accept: the cheapest stretches that hold the
wanted share of its words, less the weight that may differ in them.  So no document is lost by retrieval.  Impacts are
divided by it; 1 is the bar for all.

What is retrieved is verified on the words themselves: shared word pairs are chained into stretches of the item, a
stretch counts when it is long enough and has the item's own names and figures (by weight), and the counted stretches
must hold the wanted share of the item's words.  The answer's overlap is reported beside it.

Documents are read once and never shuffled for this (but see ``spread``); the index is broadcast in blocks of about
``BLOCK`` items, each block is one more pass, so the broadcast is bounded however many items there are.  Word weights and
lengths are taken over all items, whatever block an item is in.

Defined results: NULL and empty texts carry nothing; items of fewer than ``MIN_STRETCH`` words are carried only as a
whole; repeated items are reported each; whole texts are searched, however long.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrun.llm.spread import spread
from tallyrun.llm.text import words

BLOCK = 5_000
#: Share of an item's words that makes a case.
SHARE = 0.5
#: Words of a stretch, words that may differ between two of its shared pairs, and the weight it must share.
MIN_STRETCH, MAX_GAP, MIN_WEIGHT = 6, 3, 0.75
#: BM25's parameters and the length of a block of postings.
K1, B, POSTINGS_BLOCK = 1.2, 0.75, 32
#: The bar of all items, less what single precision may lose; impacts looked at together.
BAR, MOST_SCORES = 1 - 1e-4, 4_000_000


def cheapest_stretches(cost: np.ndarray, wanted: int, least: int) -> float:
    """Lowest total cost of stretches of at least ``least`` places that together hold ``wanted`` places.

    One pass over the places; ``state[r][j]`` is the cheapest way to have j places (``wanted`` at most) with the current
    stretch r long (``least`` at most, 0 outside).
    """
    wanted = min(wanted, len(cost))
    if wanted <= 0:
        return 0.0
    state = np.full((least + 1, wanted + 1), np.inf)
    state[0, 0] = 0.0
    for c in cost:
        more = np.full_like(state, np.inf)
        more[:, 1:] = state[:, :-1] + c
        more[:, wanted] = np.minimum(more[:, wanted], state[:, wanted] + c)
        after = np.full_like(state, np.inf)
        after[0] = np.minimum(state[0], state[least])
        after[1:least] = more[: least - 1]
        after[least] = np.minimum(more[least - 1], more[least])
        state = after
    return float(min(state[0, wanted], state[least, wanted]))


#: Number of all items, their words together, and in how many of them each word of a block's items occurs.
Statistics = tuple[int, int, dict[str, int]]


class ItemIndex:
    """Inverted index of test items and the check of a document against one of them."""

    def __init__(self, items: Sequence[tuple[int, str | None, str | None]], share: float = SHARE, statistics: Statistics | None = None) -> None:
        self.share = share
        self.keys = [i[0] for i in items]
        self.words = [words(i[1]) for i in items]
        self.answers = [words(i[2]) for i in items]
        sizes = [len(w) for w in self.words]
        n, total, df = statistics or (len(items), sum(sizes), Counter(t for w in self.words for t in set(w)))
        mean = total / max(1, n) or 1.0
        self.idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.needed = [0.0] * len(items)
        for i, w in enumerate(self.words):
            if not w:
                continue
            tf = Counter(w)
            score = {t: self.idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * sizes[i] / mean)) for t, c in tf.items()}
            each = np.array([score[t] / tf[t] for t in w])
            top = (K1 + 1) / (1 + K1 * (1 - B + B * sizes[i] / mean))
            lost = (1 - MIN_WEIGHT) * top * np.array([self.idf[t] for t in w])
            stretches = cheapest_stretches(each - lost, math.ceil(share * sizes[i] - 1e-9), min(MIN_STRETCH, sizes[i]))
            bar = max(stretches, 1e-9)
            self.needed[i] = MIN_WEIGHT * sum(sorted(self.idf[t] for t in w)[: math.ceil(share * sizes[i] - 1e-9)]) * (1 - 1e-9)
            for t, s in score.items():
                lists[t].append((i, s / bar))
        self._blocks(lists)

    def _blocks(self, lists: dict[str, list[tuple[int, float]]]) -> None:
        """The postings by blocks of items: a bound per term and block, and the impacts of those blocks that have any."""
        count = -(-len(self.keys) // POSTINGS_BLOCK)
        self.rows = {t: r for r, t in enumerate(lists)}
        self.bounds = np.zeros((len(lists), count), np.float32)
        self.where = np.zeros((len(lists), count), np.int32)
        impacts = [np.zeros(POSTINGS_BLOCK, np.float32)]
        for t, r in self.rows.items():
            for item, s in lists[t]:
                block, at = divmod(item, POSTINGS_BLOCK)
                if not self.where[r, block]:
                    self.where[r, block] = len(impacts)
                    impacts.append(np.zeros(POSTINGS_BLOCK, np.float32))
                impacts[self.where[r, block]][at] = s
                self.bounds[r, block] = max(self.bounds[r, block], s)
        self.impacts = np.array(impacts)

    def retrieve(self, terms: Iterable[str]) -> list[int]:
        """Block-max WAND: every item whose score reaches its bar.

        The weak AND is taken for all blocks of items at once: the terms' block maxima are added up, and only blocks in
        which the sum reaches the bar are opened and scored.
        """
        rows = np.array([r for t in terms if (r := self.rows.get(t)) is not None], np.int64)
        if not len(rows):
            return []
        opened = np.flatnonzero(self.bounds[rows].sum(axis=0) >= BAR)
        step = max(1, MOST_SCORES // (len(rows) * POSTINGS_BLOCK))
        out: list[int] = []
        for k in range(0, len(opened), step):
            blocks = opened[k : k + step]
            scores = self.impacts[self.where[rows[:, None], blocks]].sum(axis=0)
            block, at = np.nonzero(scores >= BAR)
            out += (blocks[block] * POSTINGS_BLOCK + at).tolist()
        return out

    def carried(self, item: int, pairs: dict[tuple[str, str], list[int]]) -> float:
        """Share of the item's words that the document holds in stretches; ``pairs`` are its word pairs' places."""
        own = self.words[item]
        size = len(own)
        met = {k for j in range(size - 1) if (own[j], own[j + 1]) in pairs for k in (j, j + 1)}
        if size > 1 and sum(self.idf[own[k]] for k in met) < self.needed[item]:
            return 0.0  # the shared pairs have less weight than any accepted stretches
        seeds = sorted((at, j) for j in range(size - 1) for at in pairs.get((own[j], own[j + 1]), ()))
        chains: list[list[int]] = []  # last place, last word, shared words
        done: list[list[int]] = []
        for at, j in seeds:
            best = None
            for c in chains:
                da, dj = at - c[0], j - c[1]
                if 0 < da <= MAX_GAP + 1 and 0 < dj <= MAX_GAP + 1 and (best is None or abs(da - dj) < best[0]):
                    best = (abs(da - dj), c)
            if best:
                best[1][0], best[1][1] = at, j
                best[1].append(j)
            else:
                chains.append([at, j, j])
            if len(chains) > 8:
                live = [c for c in chains if c[0] >= at - MAX_GAP - 1]
                done += [c for c in chains if c[0] < at - MAX_GAP - 1]
                chains = live
        held: set[int] = set()
        least = min(MIN_STRETCH, size)
        for c in [*done, *chains]:
            shared = {k for j in c[2:] for k in (j, j + 1)}
            span = range(min(shared), max(shared) + 1)
            if len(shared) >= least:
                weight = sum(self.idf[own[k]] for k in shared)
                if weight >= MIN_WEIGHT * sum(self.idf[own[k]] for k in span):
                    held.update(span)
        return len(held) / size if size else 0.0

    def leaks(self, text: str | None) -> list[tuple[int, float, float]]:
        """``(item, share of its words, share of its answer's words)`` for every item the text carries."""
        own = words(text)
        if not own:
            return []
        found = self.retrieve(sorted(set(own)))
        if not found:
            return []
        wanted = {p for i in found for p in zip(self.words[i], self.words[i][1:], strict=False)}
        pairs: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k, p in enumerate(zip(own, own[1:], strict=False)):
            if p in wanted:
                pairs[p].append(k)
        present, out = set(own), []
        for i in found:
            part = self.carried(i, pairs) if len(self.words[i]) > 1 else 1.0
            if part >= self.share:
                answer = self.answers[i]
                out.append((self.keys[i], part, sum(w in present for w in answer) / len(answer) if answer else 0.0))
        return out


def block_statistics(items: DataFrame, blocks: int) -> Iterator[Statistics]:
    """For every block in turn the statistics of all items; the driver holds the words of one block only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [(b, words(t)) for b, t in zip(batch["block"], batch["text"], strict=True)]
            rows = [(b, w, 0) for b, ws in own for w in set(ws)] + [(b, None, len(ws)) for b, ws in own]
            yield pd.DataFrame(rows, columns=["block", "word", "size"])

    found = items.select(_block(blocks).cast("int").alias("block"), "text").mapInPandas(run, "block int, word string, size long")
    n, total = found.filter("word IS NULL").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    found = found.filter("word IS NOT NULL")
    counts = found.groupBy("word").agg(F.count("*").alias("n"))
    for b in range(blocks):
        yield n, total, {r["word"]: r["n"] for r in counts.join(found.filter(F.col("block") == b).select("word").distinct(), "word").collect()}


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("item_id"), F.lit(blocks))


def leaked_items(documents: DataFrame, items: DataFrame, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """Columns ``doc_id, item_id, question_overlap, answer_overlap``: every item that a document carries."""
    spark = documents.sparkSession
    texts = spread(documents.select("doc_id", "text"), "doc_id")
    blocks = max(1, -(-items.count() // block))
    out = None
    for b, statistics in enumerate(block_statistics(items, blocks) if blocks > 1 else [None]):
        rows = items.filter(_block(blocks) == b).select("item_id", "text", "answer").collect()
        shared = spark.sparkContext.broadcast(ItemIndex(sorted((tuple(r) for r in rows), key=lambda r: r[0]), share, statistics))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            index = shared.value
            for batch in batches:
                found = [(d, *leak) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for leak in index.leaks(t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "question_overlap", "answer_overlap"])

        one = texts.mapInPandas(run, "doc_id long, item_id long, question_overlap double, answer_overlap double")
        out = one if out is None else out.unionByName(one)
    return out
