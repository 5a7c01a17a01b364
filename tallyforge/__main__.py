"""Command line: python -m tallyforge JOB ... (see --help)."""

from __future__ import annotations

import argparse
import json

from tallyforge.operators import drivers, runs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tallyforge", description="Jobs over evaluation runs.")
    jobs = top.add_subparsers(dest="job", required=True)
    g = jobs.add_parser("generate", help="generate missing cells of a run")
    g.add_argument("--tasks", required=True)
    g.add_argument("--run", required=True)
    g.add_argument("--model", action="append", required=True, type=runs.parse_model_spec, help="model:mode, repeatable")
    g.add_argument("--condition", default="direct")
    g.add_argument("--problems", default="all", type=runs.parse_ids)
    g.add_argument("--samples", type=int, default=1)
    g.add_argument("--temperature", type=float)
    g.add_argument("--max-new-tokens", type=int, default=200)
    g.add_argument("--seed", type=int, default=42)
    g.add_argument("--resume", action="store_true")
    for name, text in (("grade", "grade a run"), ("dedup", "count duplicate records of a run")):
        p = jobs.add_parser(name, help=text)
        p.add_argument("--run", required=True)
        p.add_argument("--policy", default="first", choices=["first", "last", "prefer_success"])
        if name == "grade":
            p.add_argument("--tasks", required=True)
            p.add_argument("--run-code", action="store_true")
    c = jobs.add_parser("compare", help="compare two graded runs")
    c.add_argument("--baseline", required=True)
    c.add_argument("--treatment", required=True)
    v = jobs.add_parser("validate", help="check and freeze a task set")
    v.add_argument("--tasks", required=True)
    v.add_argument("--expected", type=int)
    v.add_argument("--manifest")
    e = jobs.add_parser("eval20", help="grade and report wide outputs")
    e.add_argument("--outputs", required=True)
    e.add_argument("--run", help="folder for tables and page of more outputs than the driver holds")
    e.add_argument("--overrides")
    e.add_argument("--run-code", action="store_true")
    for name, text in (("ablation", "generate and grade the prompt formats"), ("audit", "sample again what few-shot got wrong")):
        p = jobs.add_parser(name, help=text)
        p.add_argument("--tasks", required=True)
        p.add_argument("--run", required=True)
        p.add_argument("--model", action="append", required=True, type=runs.parse_model_spec, help="model:mode, repeatable")
        p.add_argument("--samples", type=int, default=1 if name == "ablation" else 5)
        p.add_argument("--temperature", type=float, default=None if name == "ablation" else 0.3)
        p.add_argument("--max-new-tokens", type=int, default=200)
        p.add_argument("--seed", type=int, default=0)
        if name == "ablation":
            p.add_argument("--problems", default="all", type=runs.parse_ids)
        else:
            p.add_argument("--outputs", required=True)
            p.add_argument("--reclassify", action="store_true")
    i = jobs.add_parser("inspect", help="records of a run with their predictions")
    i.add_argument("--run", required=True)
    i.add_argument("--problem", type=int, required=True)
    return top


def run(spark, args: argparse.Namespace) -> str:
    """The job's report as text."""
    show = lambda x: json.dumps(x, indent=2, ensure_ascii=False, default=str)
    if args.job == "generate":
        options = runs.RunOptions(tuple(args.model), args.condition, args.samples, args.temperature is not None, args.temperature, args.max_new_tokens, args.seed)
        return show(drivers.generate_run(spark, args.tasks, args.run, options, ids=args.problems, log_exists=args.resume))
    if args.job == "grade":
        return show(drivers.grade_run(spark, args.run, args.tasks, run_code=args.run_code, policy=args.policy))
    if args.job == "dedup":
        return show(drivers.rows_of(drivers.clean_log(spark, args.run, policy=args.policy)[1]))
    if args.job == "compare":
        return drivers.compare_run_folders(spark, args.baseline, args.treatment)[1]
    if args.job == "validate":
        return show(drivers.validate_tasks(spark, args.tasks, expected=args.expected, manifest_path=args.manifest))
    if args.job in ("ablation", "audit"):
        options = runs.RunOptions(tuple(args.model), "few_shot", args.samples, args.temperature is not None, args.temperature, args.max_new_tokens, args.seed)
        if args.job == "ablation":
            return show(drivers.rows_of(drivers.ablation_run(spark, args.tasks, args.run, options, ids=args.problems)[1].orderBy("model_id", "condition")))
        audit, by_hand = drivers.audit_run(spark, args.tasks, args.outputs, args.run, options, reclassify=args.reclassify)
        return show({"audit": drivers.rows_of(audit.orderBy("task_id", "model_id")), "review_by_hand": [r.task_id for r in by_hand.orderBy("task_id").collect()]})
    if args.job == "inspect":
        return show(drivers.rows_of(drivers.inspect_run(spark, args.run, args.problem)))
    if args.run:
        found = drivers.eval20_run(spark, args.outputs, args.run, args.overrides, run_code=args.run_code)
        return show({name: drivers.rows_of(found[name]) for name in ("conditions", "behavior", "pairwise")})
    return drivers.eval20(spark, args.outputs, args.overrides, run_code=args.run_code)[2]


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    print(run(SparkSession.builder.appName("tallyforge").config("spark.sql.session.timeZone", "UTC").getOrCreate(), parser().parse_args()))
