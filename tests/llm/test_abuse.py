import itertools
import random

import pytest

from tallyrun.llm import abuse as A
from tallyrun.llm.abuse import Speller, extreme_value_law, maximal_segments, score_documents, word_lists
from tallyrun.llm.abuse_terms import report_words, seeds

FILLER = ["the second half belonged to the visitors, who had nine corners", "my dad took me there in 1957, trains were better then", "oh for fucks sake, not again", "absolutely filthy finish, more of that please", "the referee added four minutes"]
BAD = ["You are a slimy wanker, nobody asked you.", "Those scum are rats and parasites.", "I will slit your throat.", "Halt die Fresse, du Arschloch.", "Te voy a matar, sé dónde vives.", "Ferme ta gueule, connard.", "suck my dick and swallow"]
GOOD = ["The club condemned the racist chants and handed the recording to the police.", 'The report lists the words "idiot" and "scum" as shouted by one supporter, who was banned for 6 matches.', "Calling anyone a bastard on this board gets you a ban, no warnings.", "My own performance was pathetic and I was an idiot to take that penalty.", "A bruised breast bone kept him out.", "The ground stands beside the cemetery of Dickholm."]


def samples():
    rng = random.Random(1)
    text = lambda *s: " ".join([*rng.sample(FILLER, 2), *s])
    return [(text(b), 1) for b in BAD * 3] + [(text(g), 0) for g in GOOD * 5] + [(text(), 0) for _ in range(20)] + [(BAD[0], 0)]


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(2)
    pad = lambda s: ". ".join([*rng.sample(FILLER, 3), s, *rng.sample(FILLER, 2)])
    bad = [*BAD, "you are a m.o.r.o.n", "what a w4nk3r you are", "you stupid c u n t", "The owner is a cretіn.", "The manager is a wakner.", "you worthlesssss priiiick", "Oi a******e, listen", "You <b>are</b> a cun<i>t</i>"]
    good = [*GOOD, *FILLER, "we murdered them in midfield", "holy shit what a save", "Rats had got into the kitchen."]
    rows = [(i, pad(s), "f", 1) for i, s in enumerate(bad)] + [(100 + i, pad(s), "g", 0) for i, s in enumerate(good)] + [(900, None, None, 0), (901, "", "f", 0), (902, " \n", "f", 0), (903, pad(FILLER[0]) * 400, "g", 0)]
    rows += [(1000 + i, pad(FILLER[i % 5]), "g", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    revs = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(samples())] + [(999, None, 1), (998, "x", None)], "sample_id long, text string, flagged int")
    return docs, revs, {r["doc_id"]: r for r in score_documents(docs, revs).collect()}


def test_texts_are_told_apart(judged):
    docs, _, got = judged
    truth = {r["doc_id"]: bool(r["score"]) for r in docs.collect()}
    assert {d: r["flagged"] for d, r in got.items()} == truth
    assert got[900]["score"] == 0 and got[901]["score"] == 0 and got[0]["score"] > 0 and "wanker" in got[0]["segment"]


def test_empty_tables_and_no_samples(spark, judged):
    docs, revs, _ = judged
    assert score_documents(docs.limit(0), revs).count() == 0
    assert score_documents(docs, revs.limit(0)).filter("flagged AND doc_id < 7").count() == 7


def test_segments_against_brute_force():
    rng = random.Random(3)

    def brute(s):
        """Maximal segments by their definition: repeatedly the best segment, then left and right of it."""
        if not s:
            return []
        best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i, j in itertools.combinations(range(len(s) + 1), 2)), default=None)
        if best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return [*brute(s[:i]), (best[0], i, j), *[(v, a + j, b + j) for v, a, b in brute(s[j:])]]

    for _ in range(300):
        s = [rng.choice((-3, -2, -1, 1, 2, 3)) + rng.random() / 100 for _ in range(rng.randrange(1, 14))]
        sparse, drift, below = [], [], 0.0
        for i, v in enumerate(s):
            if v > 0:
                sparse.append((i, v))
                drift.append(below)
                below = 0.0
            else:
                below += v
        assert [(round(v, 6), a, b) for v, a, b in maximal_segments(sparse, drift)] == [(round(v, 6), a, b) for v, a, b in brute(s)]


def test_extreme_value_law_against_simulation():
    import numpy as np

    shares = {1.0: 0.1, -1.0: 0.9}
    decay, scale = extreme_value_law(shares)
    assert decay == pytest.approx(np.log(9), abs=1e-6)
    rng = np.random.default_rng(5)
    n, trials, hits = 2000, 400, 0
    for _ in range(trials):
        x = np.concatenate([[0], np.cumsum(rng.choice([1, -1], n, p=[0.1, 0.9]))])
        hits += (x - np.minimum.accumulate(x)).max() >= 3
    assert hits / trials == pytest.approx(1 - np.exp(-scale * n * np.exp(-decay * 3)), abs=0.08)


def test_spelling_is_undone():
    s = Speller(*word_lists())
    for text, word in (("w-a-n-k-e-r", "wanker"), ("m o r o n", "moron"), ("1d107", "idiot"), ("moooron", "moron"), ("w***e", "whore"), ("lwolife", "lowlife"), ("сunt", "cunt"), ("WANKER", "wanker"), ("afuckingscumbag", "scumbag")):
        assert word in s.tokens(text), text
    assert s.tokens("Cedro and 1. FC Cockermoor") == ["cedro", "and", "0", A.END, "fc", "cockermoor"]


def test_every_seed_is_found_in_its_own_text():
    matcher, speller = A.Matcher(seeds()), Speller(*word_lists())
    for f in seeds():
        text = " ".join(speller.tokens("so " + " ".join(f) + " then"))
        assert (matcher.grams.index(f), 1, len(f)) in list(matcher.find(text)), f
    assert not list(A.Matcher([]).find("some text")) and report_words()


def test_matcher_against_brute_force():
    rng = random.Random(8)
    for _ in range(100):
        tokens = [rng.choice("ab\n") for _ in range(rng.randrange(30))]
        grams = list({tuple(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(5)})
        want = sorted((i, a, a + len(g) - 1) for i, g in enumerate(grams) for a in range(len(tokens)) if tuple(tokens[a : a + len(g)]) == g)
        assert sorted(A.Matcher(grams).find(" ".join(tokens))) == want


def test_every_significant_passage_counts_and_length_alone_does_not():
    model = A.Model({("wanker",): 16.0, ("stupid",): 3.5}, decay=0.5, scale=0.054)
    filler = " ordinary words" * 50
    one = model.judge("you wanker" + filler)
    assert one[3] == ["wanker"] and model.judge("you wanker" + filler * 300) == one
    assert model.judge("how stupid" + filler)[3] == [] and model.judge("fine" + filler)[:2] == (0.0, 300.0)
    scores = [model.judge(("you wanker" + filler + " ") * k + "more" + filler * 100)[0] for k in (1, 2, 3, 10, 400)]
    assert scores == sorted(set(scores)) and scores[-1] > 1000
    mixed = model.judge("wanker wanker" + filler + " stupid" + filler + " wanker" + filler)
    assert mixed[2] == "wanker wanker" and mixed[3] == ["wanker wanker", "wanker"]
    assert mixed[0] >= model.judge("wanker wanker" + filler)[0]


def test_contexts_reports_and_phrases():
    model = A.Model({("filthy",): 3.0, ("pig",): 9.0}, {("filthy", "finish"): 0.0, ("filthy", "pig"): 5.0}, {tuple("they breed like that".split()): 9.0, tuple("breed like that here".split()): 8.0})
    places = lambda t: dict(model.positive_scores(t))
    assert places("a filthy finish") == {} and places("a filthy pig") == {1: 5.0, 2: 5.0} and places("so filthy") == {1: 3.0}
    assert places("a pig was condemned") == {1: 4.0} and places("you pig were condemned") == {1: 9.0} and places("a pig \n condemned") == {1: 9.0}
    assert places("they breed like that here") == {4: 9.0}


def test_words_are_learnt_by_their_company(spark):
    """A phrase beside abuse far more often than texts alike is abuse; a harmless use of a seed is learnt."""
    rng = random.Random(11)
    fill = lambda n: " ".join(rng.choice(("ball", "goal", "pass", "half", "team", "coach", "corner", "draw")) for _ in range(n))
    hidden, harmless, plain = "may your boots fill with sand", "an absolutely filthy finish by him", "the gate was good today"
    insult = lambda: "you are a " + rng.choice(("wanker", "cunt", "dickhead", "arsehole", "bastard", "bitch", "whore", "scumbag", "moron", "cretin", "twat", "tosser"))
    rows = []
    for i in range(4000):
        parts = [fill(35)]
        if i % 10 == 0:
            parts += [insult(), fill(30), *([hidden] if i % 20 == 0 else [insult()] if i % 30 == 0 else [fill(5)])]
        else:
            parts += [hidden if i % 100 == 1 else harmless if i % 7 == 3 else fill(5), fill(30), plain if i % 3 == 0 else fill(5)]
        rows.append((i, ". ".join(parts), "forum"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "sample_id long, text string, flagged int")
    got = {r["doc_id"]: r["flagged"] for r in score_documents(docs, none).collect()}
    assert got == {i: i % 10 == 0 or i % 100 == 1 for i in range(4000)}


def test_expected_sets_against_simulation():
    import math

    import numpy as np

    assert A.log_expected_sets([5.0]) == pytest.approx(-5.0)
    for r, u in ((1, 0.5), (3, 9.0), (8, 2.5), (40, 60.0)):
        assert A.log_erlang_tail(r, u) == pytest.approx(math.log(math.exp(-u) * sum(u**k / math.factorial(k) for k in range(r))), abs=1e-9)
    rng = np.random.default_rng(7)
    least, sums, trials = -math.log(A.EXPECTED), 8.5, 2_000_000
    pairs = 0
    for n in rng.poisson(A.EXPECTED, trials):
        x = least + rng.exponential(size=n)
        pairs += sum(a + b >= sums for a, b in itertools.combinations(x, 2))
    assert pairs / trials == pytest.approx(math.exp(A.log_expected_sets([sums / 2, sums / 2])), rel=0.1)
