import json
import zipfile

import pytest
from football import ROWS, catalog
from pyspark.sql import functions as F

from tallyrun.functions import scalars as S
from tallyrun.operators import clean, perturb, sampling
from tallyrun.operators.ordered import overlap_counts, stints
from tallyrun.plans import templates as T
from tallyrun.plans.catalog import COLUMNS
from tallyrun.plans.compare import match_sets, summarise
from tallyrun.plans.experiment import EchoGenerator, ExactGrader, evaluate, generate, prompts
from tallyrun.plans.provenance import row_ref, truth_rows
from tallyrun.sources import files, sinks


def frame(spark, name, rows=None):
    return spark.createDataFrame(rows or ROWS[name], ", ".join(f"{c} string" for c in COLUMNS[name]))


def one(spark, expr, **cells):
    row = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{c} string" for c in cells)) if cells else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def test_scalars(spark):
    d = lambda t: F.lit(t).cast("date")
    cases = [
        (S.integer_text(F.lit("7.0")), "7"), (S.integer_text(F.lit("12.5")), "12.5"), (S.integer_text(F.lit(" ")), None), (S.whole_number(F.lit("12.0")), 12),
        (S.age_on(d("2004-02-29"), d("2025-02-28")), 20), (S.age_on(d("2004-02-29"), d("2025-03-01")), 21), (S.month_shifted(F.lit(11), F.lit(3)), 2),
        (S.table_key(F.lit("a + b;c")), "a; b; c"), (S.placeholder_names(F.lit("{x} and {y} and {x}")), ["x", "y"]), (S.joined(F.array().cast("array<string>")), "NULL"),
        (S.joined(F.array(F.lit(""))), ""), (S.as_truth(F.lit("YES")), "true"), (S.as_accuracy(F.lit("n/a")), None), (S.iso_date(F.lit("x")), None),
        (S.file_slug(F.lit("a b/c?")), "a_b_c"), (S.level_title(F.lit("level_1")), "Level 1"), (S.json_object(F.lit('so: {"a": 2}!'), "a int")["a"], 2),
        (S.accuracy_text(F.lit(1.0), F.lit(3)), "0.3333"), (S.accuracy_count_text(F.lit(2.0)), "2"), (S.straight_text(F.lit("“a”  b ")), '"a" b'), (S.unbraced(F.lit(" {x} ")), "x"),
    ]
    for expr, want in cases:
        assert one(spark, expr) == want


def test_cleaning(spark):
    raw = {n: frame(spark, n) for n in COLUMNS}
    raw["players"] = frame(spark, "players", [*ROWS["players"], ("3.0", " Cem ", "2019", *[""] * 10), ("4", "Dia", "", *[""] * 10)])
    raw["clubs"] = raw["clubs"].drop("country_name")
    raw["countries"] = frame(spark, "countries", [("9", "Alphaland", "AL", "europa", "", ""), ("9", "Gammaländ (x)", "GA", "", "", "")])
    capitals = spark.createDataFrame([("Alphaland", "Acity", "Europe"), ("gammaland", "Gcity", "Asia"), ("Alphaland ", "Other", "Europe"), ("", "x", "y")], "Country string, Capital string, Region string")
    done = clean.clean_all(raw, capitals)
    assert [r["player_id"] for r in done["players"].orderBy("player_id").collect()] == ["1", "2"]
    countries = {r["country_name"]: (r["country_id"], r["country_code"], r["confederation"]) for r in done["countries"].collect()}
    assert countries == {"Alphaland": ("1", "AL", "europa"), "gammaland": ("2", "GA", "NULL")}
    assert {r["club_id"]: r["country_name"] for r in done["clubs"].collect()}["30"] == "Gammaland"
    comps = {r["competition_id"]: (r["country_id"], r["competition_code"]) for r in done["competitions"].collect()}
    assert comps["A1"] == ("1", "A1") and comps["B1"][0] == "2" and comps["CL"][0] == "-1"
    assert sorted(r["game_event_id"] for r in done["game_events"].collect()) == ["e1", "e2", "e3"]
    assert done["transfers"].count() == 7 and done["appearances"].count() == 6
    assert {r["column_name"]: r["missing"] for r in clean.missing_counts(done["players"]).collect()}["height_in_cm"] == 1


def test_perturbation_is_a_derangement(spark):
    rows = [(str(i), f"c{i % 7}", "x" if i % 5 else "") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, v string, w string")
    m = {r["old_v"]: r["new_v"] for r in perturb.derangement(df, ["v"], "s").collect()}
    assert sorted(m) == sorted(m.values()) and all(a != b for a, b in m.items())
    assert perturb.derangement(df, ["w"], "s").count() == 0
    out = {r["id"]: r["v"] for r in perturb.swap(df, ["v"], "s").collect()}
    assert out == {i: m[v] for i, v, _ in rows}
    players = perturb.perturbed_players(frame(spark, "players", [("1", "A", "", "", "P", "Q", "R", "2000-01-31", "", "", "left", "2", ""), ("2", "B", "", "", "S", "T", "U", "bad", "", "", "odd", "", "")])).orderBy("player_id").collect()
    assert players[0]["foot"] in ("right", "both") and players[0]["height_in_cm"] in ("1", "3", "4", "5") and players[0]["date_of_birth"] != "2000-01-31"
    assert (players[1]["date_of_birth"], players[1]["foot"], players[1]["height_in_cm"], players[1]["country_of_birth"]) == ("bad", "odd", "", "P")


def test_key_closure_and_contrast_players(spark):
    c = catalog(spark)
    tables = {n: getattr(c, n) for n in COLUMNS}
    ann = sampling.find_players(c.players, " ANN ")
    assert [r["v"] for r in sampling.contrast_players(c.transfers, ann).collect()] == ["2"]
    got = {n: df.count() for n, df in sampling.key_closure(tables, ann).items()}
    assert got == {"players": 1, "countries": 3, "clubs": 4, "competitions": 4, "games": 1, "game_events": 2, "appearances": 6, "transfers": 7}


def test_overlap_counts_without_pairs(spark):
    df = stints(catalog(spark).transfers)
    got = {(r["player_id"], r["pos"]): r["overlapping"] for r in overlap_counts(df, "club_id").collect()}
    rows = df.collect()
    far = __import__("datetime").date(9999, 12, 31)
    for a in rows:
        n = sum(a is not b and a["club_id"] == b["club_id"] and a["start"] < (b["stop"] or far) and b["start"] < (a["stop"] or far) for b in rows)
        assert got[a["player_id"], a["pos"]] == n


def test_budgeted_rows(spark):
    rows = spark.range(10).select(F.col("id").alias("row_index"), F.lit("t").alias("t"))
    pick = lambda budget, truth, **k: sorted(r["row_index"] for r in sampling.budgeted_rows(rows, ["t"], F.lit(budget), F.col("row_index").isin(*truth), F.col("row_index"), **k).collect())
    assert pick(4, [7]) == [0, 1, 2, 7] and pick(1, [3, 8]) == [3, 8] and pick(20, [1]) == list(range(10))
    assert len(pick(4, [7], seed="1")) == 4 and 7 in pick(4, [7], seed="1") and pick(4, [7], seed="1") == pick(4, [7], seed="1")


def test_templates_and_stable_ids(spark):
    text = "# players\nWhat foot does {players.name}\nprefer? (players.foot)\n\n# Scope 2\n# clubs + countries\nWhere is “{clubs.name}”? (clubs.country_name, countries.continent)\nWhere is “{clubs.name}”? (clubs.country_name, countries.continent)"
    rows = T.parse_templates(text)
    assert [r[0] for r in rows] == [0, 1, 2] and rows[0][1] == "What foot does {players.name} prefer?" and rows[1][1:4] == ('Where is "{clubs.name}"?', 2, "clubs; countries")
    old = T.templates_frame(spark, [(7, *rows[1][1:]), (3, "gone", 1, "x", "x.y")])
    assert [r["question_id"] for r in T.with_stable_ids(T.templates_frame(spark, rows), old).orderBy("question_id").collect()] == [7, 8, 9]
    seeds = T.parse_seeds("# clubs + countries\nclubs.club_id: {10}, country_name: Alphaland\n# Scope 1\nignored: 1\n")
    assert seeds == [("clubs; countries", {"clubs.club_id": "10", "country_name": "Alphaland"})]
    assert T.templates_with_seeds(spark, T.templates_frame(spark, rows), seeds).count() == 2
    assert one(spark, T.filled("Is {a.x} in {b}?", {"a.x": F.lit("P"), "b": F.lit(None)})) == "Is P in ?"
    with pytest.raises(KeyError):
        T.filled("{c}", {})


def test_comparison(spark):
    schema = "question_id string, correct string, accuracy string"
    a = spark.createDataFrame([("1", "true", "1"), ("2", "false", "0"), ("3", "true", "1"), ("4", "yes", "1"), ("5", "true", None), ("6", "true", "high")], schema)
    b = spark.createDataFrame([("1", "false", "0"), ("2", "true", "1"), ("3", "true", "0.5"), ("4", "true", "1.0"), ("6", "true", "high"), ("7", "true", "1")], schema)
    m = match_sets(a, b, ["question_id"])
    assert {r["question_id"]: (r["side"], r["transition"]) for r in m.collect()} == {"1": ("matched", "correct_to_incorrect"), "2": ("matched", "incorrect_to_correct"), "3": ("matched", "other_change"), "4": ("matched", None), "5": ("only_first", None), "6": ("matched", None), "7": ("only_second", None)}
    s = summarise(m, ["side"]).filter("side = 'matched'").first()
    assert (s["matched"], s["changed"], s["average_first"], s["delta"]) == (5, 3, "0.7500 (3/4)", "-0.1250")


def test_generation_grading_and_provenance(spark):
    q = spark.createDataFrame([("1", "who?", "who?", ""), ("2", "where?", "there", "x")], "question_id string, question string, answer string, explanation string")
    blocks = spark.createDataFrame([("1", 1, "b", "x\n1"), ("1", 0, "a", "y\n2")], "question_id string, table_no int, table_name string, csv string")
    p = prompts(q, blocks)
    text = {r["question_id"]: r["prompt"] for r in p.collect()}["1"]
    assert text.index("Table: a") < text.index("Table: b") and "Question: who?" in text
    r = generate(p, EchoGenerator, done=spark.createDataFrame([("9",)], "question_id string"))
    grades = {g["question_id"]: g["correct"] for g in evaluate(q, r, ExactGrader).collect()}
    assert grades == {"1": "true", "2": "false"}
    assert generate(p, EchoGenerator, done=r).count() == 0
    clubs = catalog(spark).clubs
    refs = clubs.filter("club_id IN ('10', '20')").select(F.lit("q").alias("question_id"), row_ref("clubs", "club_id").alias("r")).groupBy("question_id").agg(F.collect_list("r").alias("refs"))
    refs = refs.withColumn("refs", F.concat("refs", F.array(F.struct(F.lit("clubs").alias("table"), F.lit("club_id").alias("id_attribute"), F.lit("77").alias("id_value"))), "refs"))
    got = truth_rows(refs, clubs, "clubs", ["club_id"]).orderBy("ref_pos").collect()
    assert [(g["row_index"], g["csv_row"]) for g in got] == [(0, 2), (2, 4), (None, None)]


def test_files(spark, tmp_path):
    rows = [("a,b", 'say "x"', "NULL"), ("", "two\nlines", "é"), ("3", "4", "")]
    df = spark.createDataFrame(rows, "p string, q string, r string")
    path = str(tmp_path / "t.csv")
    sinks.save_csv(df.coalesce(1), path)
    back = files.read_csv(spark, path, index=True).orderBy("row_index").collect()
    assert [tuple(r)[:3] for r in back] == rows and [r["row_index"] for r in back] == [0, 1, 2]
    assert sinks.save_json_array(df, str(tmp_path / "t.json")) == 3 and json.loads((tmp_path / "t.json").read_text())[0]["p"] == "a,b"
    assert files.read_json_array(spark, str(tmp_path / "t.json"), "struct<p:string,q:string,r:string>").count() == 3
    for n, t in (("a.json", '{"correct": true}'), ("b.json", '{"question_id": 5}'), ("c.json", "[1]"), ("d.json", '{"question_id": 5, "correct": "no"}')):
        (tmp_path / "docs").mkdir(exist_ok=True)
        (tmp_path / "docs" / n).write_text(t)
    docs = {r["question_id"]: r["doc"]["correct"] for r in files.read_json_documents(spark, str(tmp_path / "docs"), "question_id string, correct string").collect()}
    assert docs == {"a": "true", "5": "no"}
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../out.txt", "x")
    with pytest.raises(ValueError):
        files.extract_archive(str(tmp_path / "bad.zip"), str(tmp_path / "in"))
    with pytest.raises(ValueError):
        sinks.prepare_folder("/")
    text = df.groupBy().agg(sinks.csv_text(["p", "q"], F.col("p")).alias("t")).first()["t"]
    assert text == 'p,q\n,"two\nlines"\n3,4\n"a,b","say ""x"""'
    tables = {n: frame(spark, n) for n in COLUMNS}
    counts = sinks.save_tables(tables, str(tmp_path / "tables"))
    assert counts["transfers"] == 7
    from tallyrun.cli import main

    assert main(["questions", "--input", str(tmp_path / "tables"), "--output", str(tmp_path / "q.json"), "--level", "3"]) == 0
    assert len(json.loads((tmp_path / "q.json").read_text())) > 100
    (tmp_path / "raw.txt").write_text("# players\nWhere was {players.name} born? (players.country_of_birth)\n")
    (tmp_path / "seeds.txt").write_text("# players\nplayers.player_id: 1\n")
    assert main(["templates", "--input", str(tmp_path / "raw.txt"), "--output", str(tmp_path / "level_1.csv")]) == 0
    assert (tmp_path / "level_1.csv").read_text().splitlines()[0] == '"question_id","question","num_tables","tables","attributes"'
    assert main(["questions", "--input", str(tmp_path / "tables"), "--output", str(tmp_path / "q1.json"), "--level", "1", "--templates", str(tmp_path / "level_1.csv"), "--seeds", str(tmp_path / "seeds.txt")]) == 0
    record = json.loads((tmp_path / "q1.json").read_text())
    assert [(r["question"], r["answer"], r["level"], r["ground_truth"]["answer_source"]["attribute"]) for r in record] == [("Where was Ann born?", "Alphaland", "level_1", "country_of_birth")]
    assert main(["perturb", "--input", str(tmp_path / "tables"), "--output", str(tmp_path / "changed")]) == 0
    assert main(["sample", "--input", str(tmp_path / "tables"), "--output", str(tmp_path / "sample"), "--player", "ann"]) == 0


def test_questions_to_prompts_grades_and_markdown(spark, tmp_path):
    from tallyrun.cli import main
    from tallyrun.plans import stages

    data, root = str(tmp_path / "tables"), tmp_path / "questions"
    sinks.save_tables({n: frame(spark, n) for n in COLUMNS}, data)
    templates = tmp_path / "level_3.csv"
    lines = ['6,"How often did {transfers.player_name} stay in a country?",2,"transfers; clubs","transfers.to_club_id; clubs.name"', '76,"Who was with {transfers.player_name}?",1,"transfers","transfers.transfer_date"']
    templates.write_text("\n".join(["question_id,question,num_tables,tables,attributes", *lines, ""]))
    questions = str(root / "level_3.json")
    assert main(["questions", "--input", data, "--output", questions, "--level", "3", "--templates", str(templates)]) == 0
    found = {r["question_id"]: r for r in json.loads((root / "level_3.json").read_text())}
    assert set(found) == {"6-1", "6-2", "76-1", "76-2"}
    ann = found["6-1"]
    assert ann["question"] == "How often did Ann stay in a country?" and ann["answer"] == "0"
    assert ann["ground_truth"]["rows"][0] == {"table": "transfers", "id_attribute": "player_id+transfer_date+from_club_id+to_club_id", "id_value": "1|2023-01-10|20|10"}
    assert len(ann["ground_truth"]["rows"]) == 4 + 4 + 3 and ann["ground_truth"]["answer_source"]["operation"] == "count_same"
    assert ann["explanation"].startswith("transfers[player_id+transfer_date+from_club_id+to_club_id=1|2023-01-10|20|10] has to_club_id=10. clubs[club_id=20] has name=B-One. ")
    assert {r["id_value"][:1] for r in found["76-1"]["ground_truth"]["rows"]} == {"1", "2"}

    q, tables = stages.read_questions(spark, questions), stages.read_data(spark, data)
    some = {n: tables[n] for n in ("clubs", "transfers")}
    for policy in ("first", "random"):
        rows = stages.sampled_rows(q, some, 6, policy)["clubs"].collect()
        assert len([r for r in rows if r["question_id"] == "6-1"]) == 4 == len([r for r in rows if r["question_id"] == "6-1" and r["is_truth"]])  # truth beyond the budget of 2
    more = stages.sampled_rows(q, some, 60)["transfers"].filter("question_id = '6-1'").collect()
    assert len(more) == 7 == len({r["row_index"] for r in more}) and sum(r["is_truth"] for r in more) == 4

    results, grades = str(tmp_path / "results"), str(tmp_path / "grades")
    assert main(["run", "--questions", questions, "--input", data, "--output", results, "--rows", "6", "--model", "none"]) == 0
    doc = json.loads((tmp_path / "results" / "6-1.json").read_text())
    assert "Table: transfers" in doc["prompt"] and doc["sampling"]["tables"][0]["csv"] and doc["reference_full_answer"].startswith("Answer: 0. Explanation: ")
    assert stages.run_generation(q, tables, results, EchoGenerator, "none") == 0
    assert main(["evaluate", "--questions", questions, "--results", results, "--output", grades]) == 0
    assert json.loads((tmp_path / "grades" / "6-1.json").read_text())["correct"] == "false" and stages.without_documents(q, grades).count() == 0

    assert main(["export", "--questions", str(root), "--input", data, "--output", str(tmp_path / "all.md"), "--levels", "level_3"]) == 0
    text = (tmp_path / "all.md").read_text()
    assert text.count("#### Question 6-1 / Template 6") == 1 and "- Source CSV row numbers: 2, 3, 4, 5" in text and "## Original" in text
    written = stages.export_markdown(spark, {"original": (str(root), data)}, ["level_3"], str(tmp_path), "{variant}_{level_slug}.md")
    assert (tmp_path / "original_level3.md").read_text().startswith("# Level 3 Answer Rows - Original") and written == [str(tmp_path / "original_level3.md")]
    assert stages.resolved_model("My  Model", {"my-model": "org/My-Model-1"}) == "org/My-Model-1" and stages.resolved_model("a b") == "a-b"


def test_chat_endpoint():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tallyrun.plans.stages import ChatEndpoint

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            said = 'so: {"correct": true, "accuracy": 1}' if "Reference: yes" in asked else "no idea" if asked.startswith("Judge") else f"Answer: {asked}"
            body = json.dumps({"choices": [{"message": {"content": said}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    chat = ChatEndpoint(f"http://127.0.0.1:{server.server_port}/", "m")
    row = {"question": "q", "gold_full_answer": "yes", "reference_answer": "no", "reference_explanation_is_null": False, "model_response": "r"}
    assert chat.complete(["a", "b"]) == ["Answer: a", "Answer: b"]
    assert [g["correct"] for g in chat.grade([row, row | {"reference_explanation_is_null": True}])] == [True, None]
    server.shutdown()
