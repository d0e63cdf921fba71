from football import catalog

from tallyrun.plans.analytics import Analytics, seeds_frame
from tallyrun.plans.lookups import LEVEL_2, level_1_answers

SEED_A = {"seed_id": "A", "player_id": "1", "transfer_date": "2023-07-01", "from_club_id": "10", "to_club_id": "20", "target_date": "2024-03-01", "transfer_season": "23/24", "country_name": "Betaland", "capital_city": "Bcity", "confederation": "europa", "stadium_seats": "3000"}
EXPECTED_A = {
    0: "3", 1: "Alphaland", 2: "1", 3: "Alphaland; Betaland; Gammaland; Alphaland", 4: "Alphaland", 5: "Alphaland", 6: "0", 7: "4", 8: "Yes", 9: "2", 10: "2", 11: "23/24",
    12: "2", 13: "Europe", 14: "3", 15: "Europe; Europe; Asia; Europe", 16: "Europe", 17: "Europe", 18: "2", 19: "2", 20: "Yes", 21: "3", 22: "Acity", 23: "1", 24: "No",
    34: "Gammaland", 36: "4000", 37: "No", 38: "Yes", 39: "No", 40: "No", 42: "Asia", 43: "Gcity", 44: "asien", 45: "No", 46: "No", 47: "No", 48: "No",
    49: "domestic_league", 50: "first_tier", 51: "Gammaland", 52: "europa", 53: "1", 56: "Yes", 57: "No", 58: "Yes", 59: "No", 60: "Yes", 61: "No", 62: "Yes", 63: "No",
    64: "No", 65: "Yes", 66: "Yes", 67: "No", 68: "22", 69: "24", 70: "23", 71: "23", 72: "1", 73: "2", 74: "domestic_league; international_cup", 75: "first_tier; ucl",
}


def answers(df):
    return {r["question_id"]: r["answer"] for r in df.collect()}


def test_analytics_of_one_player(spark):
    a = Analytics(catalog(spark), seeds_frame(spark, [SEED_A]))
    got = {}
    for f in (a.destination_answers, a.pair_answers, a.current_club_answers, a.transfer_answers, a.age_answers, a.appearance_answers):
        got |= answers(f())
    assert {q: got[q] for q in EXPECTED_A} == EXPECTED_A


def test_analytics_of_a_game(spark):
    a = Analytics(catalog(spark), seeds_frame(spark, [{"seed_id": "B", "game_id": "500", "country_name": "Alphaland", "capital_city": "Acity"}]))
    assert answers(a.game_answers()) == {25: "2", 26: "1", 27: "2", 28: "1", 29: "2", 30: "2", 31: "Alphaland", 32: "3", 33: "2"}


def test_overlaps_at_a_club(spark):
    seeds = [
        {"seed_id": "C", "player_id": "1", "transfer_date": "2023-01-10", "other_player_name": "Bob", "player_name_1": "Ann", "player_name_2": "Bob"},
        {"seed_id": "D", "player_id": "1", "transfer_date": "2025-01-15", "other_player_name": "Bob", "player_name_1": "Bob", "player_name_2": "Ann"},
    ]
    rows = Analytics(catalog(spark), seeds_frame(spark, seeds)).overlap_answers().collect()
    got = {s: [r["answer"] for r in sorted(rows, key=lambda r: r["question_id"]) if r["seed_id"] == s] for s in "CD"}
    assert got["C"] == ["Bob", "1", "Yes", "Yes", "2023-03-01 to 2023-07-01", "No", "No", "NULL", "Bob"]
    assert got["D"] == ["NULL", "0", "No", "No", "No overlap", "Yes", "No", "NULL", "NULL"]


def test_single_rows_and_lookups(spark):
    c = catalog(spark)
    ann = {r["question_id"]: r["answer"] for r in level_1_answers(c, "players").collect() if r["id_value"] == "1"}
    assert [ann[q] for q in (0, 2, 3, 6, 10, 11, 12, 13, 15, 17, 22, 26)] == ["Alphaland", "Gammaland", "2000-02-29", "Yes", "No", "Yes", "2000", "February", "25", "Yes", "No", "Yes"]
    players = {(r["question_id"], r["id_value"]): r["answer"] for r in LEVEL_2["players"](c).collect()}
    assert [players[q, "1"] for q in (0, 3, 6, 7, 8)] == ["Europe", "Asia", "No", "No", "No"]
    games = {r["question_id"]: r["answer"] for r in LEVEL_2["games"](c).collect()}
    assert [games[q] for q in (46, 49, 52, 54, 60, 62, 65)] == ["Stadium A1", "Betaland", "No", "Europe", "Yes", "Europe", "Yes"]
    events = {(r["question_id"], r["id_value"]): (r["answer"], r["error"]) for r in LEVEL_2["game_events"](c).collect()}
    assert events[73, "e1"] == ("left", None) and events[73, "e4"][0] is None and events[73, "e4"][1]


def test_unknown_destination_is_an_error_and_not_an_answer(spark):
    from football import ROWS

    c = catalog(spark, transfers=[*ROWS["transfers"], ("1", "2025-06-01", "24/25", "11", "77", "A-Two", "?", "Ann")])
    got = {r["question_id"]: (r["answer"], r["error"]) for r in Analytics(c, seeds_frame(spark, [SEED_A])).destination_answers().collect()}
    assert all(a is None and e for a, e in got.values())


def test_records_of_lookups(spark):
    c = catalog(spark)
    texts = {0: "What country was {players.name} born in?", 10: "Is {players.name} right-footed?", 30: "Is {players.name}'s height exactly {height_in_cm} cm?"}
    rows = {(r["question_id"], r["id_value"]): r for r in level_1_answers(c, "players", texts).collect()}
    assert set(rows) == {(q, i) for q in texts for i in "12"}
    r = rows[0, "1"]
    assert (r["question"], r["answer"], r["explanation"]) == ("What country was Ann born in?", "Alphaland", "players.country_of_birth is Alphaland.")
    assert r["ground_truth"]["placeholders"] == {"players.name": "Ann"} and [tuple(x) for x in r["ground_truth"]["rows"]] == [("players", "player_id", "1")]
    assert tuple(r["ground_truth"]["answer_source"]) == ("players", "player_id", "1", "country_of_birth")
    texts = {21: "What continent is the country of {clubs.name}'s domestic competition in?", 25: "Does the country of {clubs.name}'s domestic competition have {countries.capital_city} as its listed capital?"}
    rows = {(r["question_id"], r["id_value"]): r for r in LEVEL_2["clubs"](c, texts).collect()}
    r = rows[21, "30"]
    assert r["answer"] == "Asia" and [tuple(x) for x in r["ground_truth"]["rows"]] == [("clubs", "club_id", "30"), ("competitions", "competition_id", "G1"), ("countries", "country_id", "3")]
    assert rows[25, "10"]["question"] == "Does the country of A-One's domestic competition have Acity as its listed capital?"
    texts = {27: "Which foot does the player prefer in game {appearance.game_id}?"}
    assert LEVEL_2["appearances"](c, texts).first()["question"] == "Which foot does the player prefer in game 500?"


def test_records_of_analytics(spark):
    texts = {
        2: "How many of {transfers.player_name}'s transfers went to {countries.country_name}?", 10: "During season {transfers.transfer_season}, how many countries for {transfers.player_name}?",
        38: "On {target_date}, did {transfers.player_name}'s club have more than {clubs.stadium_seats} seats?", 64: "After {transfers.player_name}'s transfer on {transfers.transfer_date}?",
        68: "How old was {transfers.player_name}?", 72: "After {transfers.to_club_name}, in {countries.country_name}?", 78: "Was {other_player_name} there?", 25: "In game {game_events.game_id}, {game_events.type}?",
    }
    a = Analytics(catalog(spark), seeds_frame(spark, [SEED_A, {"seed_id": "B", "game_id": "500"}]), texts)
    got = {r["question_id"]: (r["question"], r["operation"]) for r in a.all_answers().collect() if r["question_id"] in texts}
    assert got == {
        2: ("How many of Ann's transfers went to Betaland?", "count_matches_placeholder"), 10: ("During season 23/24, how many countries for Ann?", "count_distinct_in_season"),
        38: ("On 2024-03-01, did Ann's club have more than 3000 seats?", "greater_than"), 64: ("After Ann's transfer on 2023-07-01?", "compare"), 68: ("How old was Ann?", "age_on_date"),
        72: ("After B-One, in Betaland?", "count_matches_placeholder"), 78: ("Was Bob there?", "exists_overlap_with_placeholder_player"), 25: ("In game 500, Goals?", "count_matches_fixed_europe"),
    }


def test_default_seeds(spark):
    from tallyrun.plans.seeds import default_event_seed, default_transfer_seed, event_games

    c = catalog(spark)
    t = default_transfer_seed(c).first()
    assert (t["player_id"], t["transfer_date"], t["country_name"], t["stadium_seats"], t["target_date"]) == ("1", "2023-07-01", "Betaland", "3000", "2023-07-01")
    e = default_event_seed(c).first()
    assert (e["game_id"], e["country_name"], e["capital_city"]) == ("500", "Alphaland", "Acity")
    given = spark.createDataFrame([("a", "e3"), ("b", "500")], "seed_id string, event_ref string")
    assert {r["seed_id"]: r["game_id"] for r in event_games(c, given).collect()} == {"a": "500", "b": "500"}
    assert default_transfer_seed(catalog(spark, appearances=[("x", "1", "9", "10", "10", "2020-01-01", "", "A1", "", "", "", "", "")])).count() == 0
