"""python -m tallyrun.cli STAGE ...: the stages over folders of CSV files."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tallyrun.session import build_session


def _positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError(f"{text} is not positive")
    return n


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyrun", description=__doc__)
    s = p.add_subparsers(dest="stage", required=True)

    def stage(name: str, **options: dict) -> None:
        q = s.add_parser(name)
        for o, k in options.items():
            q.add_argument(f"--{o.replace('_', '-')}", **k)

    needed = {"required": True}
    stage("install", source=needed, output=needed)
    stage("clean", input=needed, output=needed, capitals={})
    stage("perturb", input=needed, output=needed, seed={"default": "42"})
    stage("sample", input=needed, output=needed, player=needed, contrast={"type": int, "default": 3})
    stage("templates", input=needed, output=needed, existing={})
    stage("questions", input=needed, output=needed, level={"type": int, "choices": (1, 2, 3), "required": True}, target_date={"default": None}, templates={}, seeds={})
    stage("compare", first=needed, second=needed, output=needed)
    answering = {"questions": needed, "ids": {"default": None, "help": "comma-separated"}, "most": {"type": _positive, "default": None}, "endpoint": {"help": "address of a chat service; without it a stand-in"}, "model": {"default": "none"}, "aliases": {"help": "JSON file of model names"}, "overwrite": {"action": "store_true"}}
    stage("run", input=needed, output=needed, rows={"type": _positive, "default": 20}, policy={"choices": ("first", "random"), "default": "random"}, seed={"default": "42"}, **answering)
    stage("evaluate", results=needed, output=needed, **answering)
    stage("export", questions=needed, input=needed, counter_questions={}, counter_input={}, output=needed, levels={"default": "level_1,level_2,level_3"}, template={"help": "file name with {level}, {level_slug}, {variant}: one file each"})
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    from tallyrun.sources import files, sinks

    if a.stage == "install":
        files.install(a.source, a.output)
        return 0
    spark = build_session(f"tallyrun-{a.stage}")
    if a.stage == "clean":
        from tallyrun.operators.clean import clean_all

        names = ("all capital cities in the world.csv", "all_capital_cities_in_the_world.csv", "world_capitals.csv", "country_capitals.csv")
        capitals = a.capitals or str(files.capitals_path(a.input, names, a.output))
        raw = {n: files.read_csv(spark, str(Path(a.input) / f"{n}.csv"), index=True) for n in files.COLUMNS}
        counts = sinks.save_tables(clean_all(raw, files.read_csv(spark, capitals, index=True)), a.output, a.input)
    elif a.stage == "perturb":
        from tallyrun.operators.perturb import perturbed

        tables = {n: df.drop("row_index") for n, df in files.read_tables(spark, a.input).items()}
        counts = sinks.save_tables(perturbed(tables, a.seed), a.output, a.input)
    elif a.stage == "sample":
        from tallyrun.operators.sampling import find_players, key_closure

        tables = {n: df.drop("row_index") for n, df in files.read_tables(spark, a.input).items()}
        players = find_players(tables["players"], a.player)
        if players.isEmpty():
            raise SystemExit(f"no player is called {a.player!r}")
        counts = sinks.save_tables(key_closure(tables, players, a.contrast), a.output, a.input)
    elif a.stage == "templates":
        from tallyrun.plans import templates as t

        new = t.templates_frame(spark, t.parse_templates(t.read_text(a.input)))
        old = spark.read.schema(t.TEMPLATE_SCHEMA).options(header=True, escape='"').csv(a.existing) if a.existing and Path(a.existing).exists() else None
        sinks.save_csv(t.with_stable_ids(new, old), a.output, ["question_id"], quoted=True)
        counts = {a.output: new.count()}
    elif a.stage == "questions":
        from tallyrun.plans import templates as t
        from tallyrun.plans.analytics import SEED_FIELDS, Analytics, seeds_frame
        from tallyrun.plans.catalog import KEYS, Catalog
        from tallyrun.plans.evidence import records
        from tallyrun.plans.lookups import LEVEL_1, LEVEL_2, level_1_answers
        from tallyrun.plans.seeds import default_event_seed, default_transfer_seed

        c = Catalog.of(files.read_tables(spark, a.input))
        texts, listed = None, {}
        if a.templates:
            rows = spark.read.schema(t.TEMPLATE_SCHEMA).options(header=True, escape='"').csv(a.templates).collect()
            texts = {r["question_id"]: r["question"] for r in rows}
            listed = {r["question_id"]: [n.strip() for n in (r["attributes"] or "").split(";") if n.strip()] for r in rows}
        seeds = t.parse_seeds(t.read_text(a.seeds)) if a.seeds and a.seeds != "default" else None
        if a.level == 3:
            if seeds:
                given = [t.seed_fields(s, SEED_FIELDS) for _, s in seeds]
                subjects = seeds_frame(spark, [{"target_date": a.target_date, **g, "seed_id": str(i)} for i, g in enumerate(given)])
            elif a.seeds == "default":
                subjects = default_transfer_seed(c).unionByName(default_event_seed(c).withColumn("seed_id", F.lit("default event")))
            else:
                subjects = c.transfers.select(F.col("player_id").alias("seed_id"), "player_id", F.lit(a.target_date).alias("target_date")).distinct()
            analytics = Analytics(c, subjects, texts)
            out = analytics.all_answers() if texts is None else records(analytics, listed)
        else:
            wanted = t.seed_ids(seeds, KEYS) if seeds is not None else None
            make = {n: (lambda n=n: level_1_answers(c, n, texts)) for n in LEVEL_1} if a.level == 1 else {n: (lambda f=f: f(c, texts)) for n, f in LEVEL_2.items()}
            parts = []
            for name, f in make.items():
                ids = [v for n, v in wanted if n == name] if wanted is not None else None
                if ids != []:
                    parts.append(f() if ids is None else f().filter(F.col("id_value").isin(ids)))
            if not parts:
                raise SystemExit("no seed names a row of this level's tables")
            out = parts[0]
            for more in parts[1:]:
                out = out.unionByName(more, allowMissingColumns=True)
        if texts is not None:
            subject = "seed_id" if a.level == 3 else "id_value"
            out = out.filter("question IS NOT NULL").withColumns({"level": F.lit(f"level_{a.level}"), "template_question_id": F.col("question_id"), "question_id": F.concat_ws("-", "question_id", subject)})
        counts = {a.output: sinks.save_json_array(out, a.output)}
    elif a.stage in ("run", "evaluate"):
        import json

        from tallyrun.plans import stages
        from tallyrun.plans.experiment import EchoGenerator, ExactGrader

        model = stages.resolved_model(a.model, json.loads(Path(a.aliases).read_text()) if a.aliases else None)
        questions = stages.select_questions(stages.read_questions(spark, a.questions), a.ids.split(",") if a.ids else None, a.most)
        service = (lambda: stages.ChatEndpoint(a.endpoint, model)) if a.endpoint else None
        if a.stage == "run":
            n = stages.run_generation(questions, stages.read_data(spark, a.input), a.output, service or EchoGenerator, model, a.rows, a.policy, a.seed, a.overwrite)
        else:
            n = stages.run_evaluation(questions, a.results, a.output, service or ExactGrader, model, a.overwrite)
        counts = {a.output: n}
    elif a.stage == "export":
        from tallyrun.plans.stages import export_markdown

        variants = {"original": (a.questions, a.input)}
        if a.counter_questions and a.counter_input:
            variants["counterfactual"] = (a.counter_questions, a.counter_input)
        counts = dict.fromkeys(export_markdown(spark, variants, a.levels.split(","), a.output, a.template), 1)
    else:
        from tallyrun.plans.compare import DOC_SCHEMA, match_sets, report, summarise

        found = None
        for model in files.common_folders(a.first, a.second):
            for level in files.common_folders(f"{a.first}/{model}", f"{a.second}/{model}", "level_*"):
                side = [files.read_json_documents(spark, f"{r}/{model}/{level}", DOC_SCHEMA).select("question_id", "doc.correct", "doc.accuracy") for r in (a.first, a.second)]
                one = match_sets(*side, ["question_id"]).select(F.lit(model).alias("model"), F.lit(level).alias("level"), "*")
                found = one if found is None else found.unionByName(one)
        if found is None:
            return 1
        sinks.save_text(a.output, report(summarise(found, ["model"]), ["model"], "By model") + "\n" + report(summarise(found, ["model", "level"]), ["model", "level"], "By level"))
        counts = {a.output: 1}
    for name, n in counts.items():
        print(f"{name}: {n} rows")
    return 0


if __name__ == "__main__":
    sys.exit(main())
