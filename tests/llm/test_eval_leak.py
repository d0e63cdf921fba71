import random

from tallyrun.llm import eval_leak as E
from tallyrun.llm.eval_leak import ItemIndex, leaked_items

NAMES = "Avo Belin Calvo Denzo Ekko Faro Gavil Hesto Isbo Jorun Kofan Lukto Marrin Nilo Orvan Pavo Quento Rasmo Silvar Tevin".split()
PLACES = "Aldur Bronsar Corvek Drelmar Espel Falkor Gantel Hovar Ilmel Jasko Kolmar Lorvo Mandel Neskar Ombrel Pellur".split()


def item(rng):
    a, b = rng.sample(NAMES, 2)
    p, q, r = rng.sample(PLACES, 3)
    return (
        f"Did {a} {p}son leave {q} United before May {rng.randrange(1950, 2020)}, when {b} {r}ek already had {rng.randrange(99)} goals for {r} Town? "
        f"Take {a} {p}son, born in {q} in {rng.randrange(1950, 2020)}, and give the age at the debut for {r} Town. Count the transfers of {b} {r}ek with {p} as destination; {q} United gives {rng.randrange(99)}."
    )


def corpus(seed=4, n=60):
    rng = random.Random(seed)
    return [(i, item(rng), "Aldur Town") for i in range(n)], rng


def test_retrieval_gives_every_item_above_the_bar():
    items, rng = corpus()
    index = ItemIndex(items)
    for _ in range(80):
        words = rng.sample([w for i in rng.sample(items, 3) for w in index.words[i[0]]], 60)
        terms = set(words)
        rows = [index.rows[t] for t in terms if t in index.rows]
        score = [float(sum(index.impacts[index.where[r, k // E.POSTINGS_BLOCK]][k % E.POSTINGS_BLOCK] for r in rows)) for k in range(len(items))]
        got = index.retrieve(sorted(terms))
        assert {k for k in range(len(items)) if score[k] > 1} <= set(got) <= {k for k in range(len(items)) if score[k] > E.BAR - 1e-4}
        assert len(got) == len(set(got))


def test_stretches_that_verification_accepts_are_never_below_the_bar():
    items, rng = corpus()
    index = ItemIndex(items)
    for k, own in enumerate(index.words):
        for _ in range(6):
            text, at = [], rng.randrange(4)
            while at < len(own):
                size = rng.randrange(6, 20)
                text += [w for w in own[at : at + size] if rng.random() > 0.06] + ["filler"] * 5
                at += size + rng.randrange(0, 12)
            if any(i == k for i, _, _ in index.leaks(" ".join(text))):
                assert k in index.retrieve(sorted(set(text)))
            pairs = {p: [] for p in zip(text, text[1:], strict=False)}
            for n, p in enumerate(zip(text, text[1:], strict=False)):
                pairs[p].append(n)
            if index.carried(k, pairs) >= index.share:
                assert k in index.retrieve(sorted(set(text)))


def test_equally_rare_words_with_every_fourth_changed_are_retrieved():
    """Items that share no words have flat weights; what verification accepts is retrieved all the same."""
    items = [(i, " ".join(f"w{i}x{k}" for k in range(60 + i % 40)), None) for i in range(100)]
    index, accepted = ItemIndex(items), 0
    for k, own in enumerate(index.words):
        for first in (0, 3, 11):
            text = [w if n % 4 else "other" for n, w in enumerate(own[first : first + len(own) // 2 + 4])]
            pairs = {p: [n] for n, p in enumerate(zip(text, text[1:], strict=False))}
            if index.carried(k, pairs) >= index.share:
                accepted += 1
                assert k in index.retrieve(sorted(set(text)))
    assert accepted > 100


def test_cheapest_stretches_against_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(60):
        n, least = int(rng.integers(2, 9)), int(rng.integers(1, 4))
        cost, wanted = rng.normal(1, 1, n), int(rng.integers(1, n + 1))
        least = min(least, n)
        sums = []
        for pick in itertools.product((0, 1), repeat=n):
            runs = [len(list(g)) for v, g in itertools.groupby(pick) if v]
            if sum(pick) >= wanted and all(r >= least for r in runs):
                sums.append(float(cost[np.array(pick, bool)].sum()))
        assert abs(E.cheapest_stretches(cost, wanted, least) - min(sums)) < 1e-9


def leaked(index, text):
    return [i for i, _, _ in index.leaks(text)]


def test_what_is_a_leak():
    items, rng = corpus()
    index = ItemIndex(items)
    text = items[7][1]
    w = text.split()
    filler = "the board met again and nobody could say why the lights went out at half time " * 3
    changed = " ".join("indeed" if i % 11 == 5 else x for i, x in enumerate(w))
    layouts = [text.upper(), text.replace(",", "").replace("?", " --"), "\n".join(" ".join(w[i : i + 6]) for i in range(0, len(w), 6)), "".join(f"<i>{x}</i> " for x in w), text.replace("e", "é"), text.replace("o", "о").replace("a", "а")]
    for t in (text, filler + text + filler, changed, *layouts, " ".join(w[: len(w) * 6 // 10]), " ".join(w[: len(w) // 3]) + " " + filler + " ".join(w[-len(w) // 3 :])):
        assert leaked(index, t) == [7], t
    other = text
    for a, b in zip(NAMES + PLACES, NAMES[1:] + NAMES[:1] + PLACES[1:] + PLACES[:1], strict=True):
        other = other.replace(a, "\x00".join(b))
    other = "".join(str((int(c) + 3) % 10) if c.isdigit() else c for c in other.replace("\x00", ""))
    for t in (other, " ".join(w[: len(w) // 4]), filler, "", None, "  ", "\x00\n"):
        assert 7 not in leaked(index, t)


def test_items_over_blocks_and_odd_tables(spark):
    items, _ = corpus(n=12)
    frame = spark.createDataFrame([(*items[0], "l"), *[(*i, "l") for i in items[1:]], (90, None, None, "l"), (91, "", "", "l"), (92, items[3][1], "x", "l")], "item_id long, text string, answer string, level string")
    docs = spark.createDataFrame([(1, "so " + items[3][1], "q"), (2, None, "q"), (3, "", "q"), (4, items[3][1] * 200 + items[5][1], "q"), (5, "so " + items[3][1], "q")], "doc_id long, text string, item_id string")
    want = {(d, i) for d in (1, 4, 5) for i in (3, 92)} | {(4, 5)}
    for block in (5_000, 4):
        got = leaked_items(docs, frame, block=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert leaked_items(docs, frame.limit(0)).count() == 0 and leaked_items(docs.limit(0), frame).count() == 0
    assert E.SHARE == 0.5


def test_blocks_do_not_change_what_is_carried(spark):
    items, rng = corpus(n=24)
    items += [(100, None, None), (101, "", "x")]
    docs = []
    for i, text, _ in items[:24]:
        for every in (3, 4, 5, 6, 7, 8):
            names = [w if w.islower() or rng.random() > 1 / every else rng.choice(NAMES) for w in text.split()]
            docs.append((len(docs), " ".join("indeed" if k % (every + 3) == i % 3 else w for k, w in enumerate(names))))
    frame = spark.createDataFrame(items, "item_id long, text string, answer string")
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    whole = ItemIndex(items)
    want = {(d, i) for d, t in docs for i, _, _ in whole.leaks(t)}
    assert 0 < len(want) < len(docs)
    for block in (5_000, 7):
        assert {(r["doc_id"], r["item_id"]) for r in leaked_items(texts, frame, block=block).collect()} == want
    for n, total, df in E.block_statistics(frame, 4):
        assert (n, total) == (26, sum(map(len, whole.words))) and df and all(df[w] == sum(w in x for x in whole.words) for w in df)
