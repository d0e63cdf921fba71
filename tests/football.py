"""A small league with known answers: three countries, four clubs, two players."""

from tallyrun.plans.catalog import COLUMNS, Catalog

ROWS = {
    "countries": [("1", "Alphaland", "AL", "europa", "Acity", "Europe"), ("2", "Betaland", "BE", "europa", "Bcity", "Europe"), ("3", "Gammaland", "GA", "asien", "Gcity", "Asia")],
    "competitions": [
        ("A1", "A1", "a", "first_tier", "domestic_league", "1", "Alphaland", "A1", "europa"),
        ("B1", "B1", "b", "first_tier", "domestic_league", "2", "Betaland", "B1", "europa"),
        ("G1", "G1", "g", "first_tier", "domestic_league", "3", "Gammaland", "G1", "europa"),
        ("CL", "CL", "c", "ucl", "international_cup", "-1", "", "", "europa"),
    ],
    "clubs": [
        ("10", "a-one", "A-One", "A1", "Alphaland", "Stadium A1", "1000"), ("11", "a-two", "A-Two", "A1", "Alphaland", "Stadium A2", "2000"),
        ("20", "b-one", "B-One", "B1", "Betaland", "Stadium B1", "3000"), ("30", "g-one", "G-One", "G1", "Gammaland", "Stadium G1", "4000"),
    ],
    "players": [
        ("1", "Ann", "2024", "ann", "Alphaland", "Acity", "Gammaland", "2000-02-29", "", "", "left", "173", ""),
        ("2", "Bob", "2024", "bob", "Betaland", "Bcity", "Betaland", "1995-07-01", "", "", "right", "", ""),
    ],
    "transfers": [
        ("1", "2023-01-10", "22/23", "20", "10", "B-One", "A-One", "Ann"), ("1", "2023-07-01", "23/24", "10", "20", "A-One", "B-One", "Ann"),
        ("1", "2024-02-28", "23/24", "20", "30", "B-One", "G-One", "Ann"), ("1", "2025-01-15", "24/25", "30", "11", "G-One", "A-Two", "Ann"),
        ("2", "2023-03-01", "22/23", "30", "10", "G-One", "A-One", "Bob"), ("2", "2023-09-01", "23/24", "10", "11", "A-One", "A-Two", "Bob"),
        ("2", "2024-01-01", "23/24", "11", "20", "A-Two", "B-One", "Bob"),
    ],
    "appearances": [
        (f"a{i}", "500", "1", club, club, day, "Ann", comp, "0", "0", "0", "0", "90")
        for i, (day, club, comp) in enumerate([("2023-02-01", "10", "A1"), ("2023-06-20", "10", "A1"), ("2023-08-01", "20", "B1"), ("2024-02-27", "20", "CL"), ("2024-02-28", "20", "B1"), ("2024-03-05", "30", "G1")])
    ],
    "game_events": [
        ("e1", "2024-01-01", "500", "5", "Goals", "10", "A-One", "1", "", "2"), ("e2", "2024-01-01", "500", "5", "Cards", "20", "B-One", "2", "", ""),
        ("e3", "2024-01-01", "500", "60", "Goals", "30", "G-One", "1", "", ""), ("e4", "2024-01-01", "500", "70", "Goals", "10", "A-One", "99", "", ""),
    ],
    "games": [("500", "A1", "2023", "1", "2024-01-01", "10", "20", "1", "0")],
}


def catalog(spark, **changes):
    tables = {}
    for name, columns in COLUMNS.items():
        rows = [(*r, i) for i, r in enumerate(changes.get(name, ROWS[name]))]
        tables[name] = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns) + ", row_index long")
    return Catalog.of(tables)
