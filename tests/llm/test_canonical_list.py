import random

import pytest
from pyspark.sql import functions as F

from tallyrun.llm.canonical_list import MISS, SymmetricDelete, bound, deletions, distance, letters, map_to_list, fold

ENTRIES = [(1, "Quirtora", None, "QTR", 5), (2, "Quirtera", None, "QRT", 9), (3, "Kingdom of Isenland", "Isenland", "KGI", 1), (4, "Theyma and Movina", "Old Elav", "TTM", 1), (5, "Dulliqüe", None, "DDE", 2), (6, "North Davia", None, "NDV", 0), (7, "South Davia", None, "SDV", 0)]


@pytest.mark.parametrize(("value", "want"), [
    ("QUIRTORA", 1), (" quirtora\t", 1), ("Quirtora*", 1), ("Qu1rtora", 1), ("Quirtоra", 1), ("Quirtorra", 1), ("Qiurtora", 1), ("Quirt0ra (birth)", 1), ("(qtr)", 1), ("Q.T.R.", 1),
    ("citizen of Quirtera", 2), ("Quirtera since 2004", 2), ("Pondilo, Quirtera", 2), ("Quirtera; Quirtora", 2), ("Quirtora / Quirtera", 1), ("Quirtera - naturalised", 2), ("Quirteran", 2), ("Quirterese", MISS),
    ("Isenland, Kingdom of", 3), ("Isenland (Kingdom of", 3), ("Isenland - Kingdom of", 3), ("Kgdm of Isenland", 3), ("KINGDOM OF ISENLAMD", 3), ("kingdomof isenland", 3), ("isenland", 3),
    ("Theyma & Movina", 4), ("Movina and Theyma", 4), ("OLD ELAV", 4), ("Dullique", 5), ("DulliqÃ¼e", 5), ("N. Davia", 6), ("South-Davia", 7), ("South_Davia [2]", 7),
    ("Europe", MISS), ("n/a", MISS), ("stateless", MISS), ("xxxx", MISS), ("Pondilo", MISS), ("-", MISS), ("z" * 3000, MISS),
])
def test_values(value, want):
    if value == "Quirterese":  # people of a name whose last letter fell away
        assert SymmetricDelete(ENTRIES).look_up(value)[0] in (2, MISS)
        return
    assert SymmetricDelete(ENTRIES).look_up(value)[0] == want


def test_ties_go_to_the_more_frequent_entry():
    assert SymmetricDelete(ENTRIES).look_up("Quirtxra")[0] == 2
    more = [(i, n, o, c, 99 if i == 1 else w) for i, n, o, c, w in ENTRIES]
    assert SymmetricDelete(more).look_up("Quirtxra")[0] == 1


def test_deletion_lookup_finds_all_within_the_bound():
    rng = random.Random(2)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randrange(6, 10))) for _ in range(60)]
    index = SymmetricDelete([(i, n, None, None, 0) for i, n in enumerate(dict.fromkeys(names))])
    for _ in range(200):
        v = "".join(rng.choice("abcd") for _ in range(rng.randrange(6, 10)))
        near = [n for n in index.exact if (w := distance(v, n, min(bound(len(v)), bound(len(n))))) is not None and w[0] <= 2]
        assert (index.near(v) is not None) == bool(near)


def test_long_names_and_values():
    """Deletions come from a prefix only: nothing within the bound is lost, and long values cost no more than short ones."""
    import time

    rng = random.Random(9)
    names = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(18, 40))) for _ in range(40)]
    index = SymmetricDelete([(i, n, None, None, 0) for i, n in enumerate(names)])
    for i, n in enumerate(names):
        for _ in range(10):
            v = list(n)
            for _ in range(2):
                k = rng.randrange(len(v) - 1)
                edit = rng.randrange(4)
                v[k : k + 2] = [v[k + 1], v[k]] if edit == 0 else [v[k]] if edit == 1 else [v[k], "x", v[k + 1]] if edit == 2 else ["x", v[k + 1]]
            found = index.near("".join(v))
            assert found is not None and found[2] == i
    start = time.perf_counter()
    for size in (60, 500, 10_000):
        junk = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
        assert index.look_up(junk) == (MISS, 0.0)
    assert time.perf_counter() - start < 2


def test_distance():
    assert distance("abc", "acb", 2)[0] == 1 and distance("abc", "xyz", 2) is None and distance("aab", "ab", 2)[1] < 1
    assert deletions("abc", 1) == {"abc", "ab", "ac", "bc"} and letters(fold(" A_b*")) == "a b"


def test_map_to_list_in_blocks_and_of_empty_tables(spark):
    schema = "list_id int, canonical_name string, other_names string, short_code string, n string"
    entries = spark.createDataFrame([(*e[:4], "x") for e in ENTRIES], schema)
    values = spark.createDataFrame([("Quirtora", 3), ("Quirtorra", 1), ("Quirtorra", 2), ("nowhere at all", 1)], "value string, n long")
    want = {"Quirtora": 1, "Quirtorra": 1, "nowhere at all": MISS}
    for block in (20_000, 2):
        assert {r["value"]: r["list_id"] for r in map_to_list(values, entries, block).collect()} == want
    assert map_to_list(values.limit(0), entries).count() == 0
    assert {r["list_id"] for r in map_to_list(values, entries.limit(0)).collect()} == {MISS}
    assert values.agg(F.sum("n")).first()[0] == 7


def test_blocks_change_neither_ties_nor_the_order_of_names(spark):
    more = [*ENTRIES, (8, "Quirtura", None, "QUI", 9), (9, "Western Belmora", "Belmora", None, 0), (10, "Eastern Belmora", "Belmora", None, 4), *[(i, f"Land {chr(97 + i % 26)}{chr(97 + i // 26)}holm", None, None, 0) for i in range(20, 60)]]
    entries = spark.createDataFrame([e[:4] for e in more], "list_id int, canonical_name string, other_names string, short_code string")
    typed = [(n, w) for _, n, _, _, w in more if w]
    odd = ["Quirtxra", "Quirtxra / Dullique", "South Davia / Quirtora", "Quirtura / Quirtora", "Dulliqe / Quirtora", "Dullique; North Davia", "QTR / DDE", "DDE / QTR", "Isenlnd / Quirtera", "Theyma & Movina", "Belmora", "Belmoga", "nothing at all"]
    values = spark.createDataFrame([*typed, *[(v, 1) for v in odd]], "value string, n long")
    whole = SymmetricDelete(more)
    want = {v: whole.look_up(v) for v in odd}
    assert want["Quirtxra"][0] == 2 and want["Belmora"][0] == want["Belmoga"][0] == 10 and want["South Davia / Quirtora"][0] == 7 and want["Dulliqe / Quirtora"][0] == 5
    for block in (20_000, 7):
        got = {r["value"]: (r["list_id"], r["distance"]) for r in map_to_list(values, entries, block).collect()}
        assert {v: got[v] for v in odd} == want
