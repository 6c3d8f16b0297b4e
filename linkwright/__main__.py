"""python -m linkwright run|generate|seed ..."""

from __future__ import annotations

import argparse
import dataclasses
import json

from pyspark.sql import SparkSession

from linkwright.config import ResolveConfig


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="linkwright")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="resolve the source files of a folder")
    run.add_argument("--data", required=True)
    run.add_argument("--output", default="outputs")
    run.add_argument("--match-threshold", type=float)
    run.add_argument("--non-match-threshold", type=float)
    run.add_argument("--max-cluster-size", type=int)
    run.add_argument("--include-uncertain", action="store_true")
    run.add_argument("--no-soundex", action="store_true")
    gen = sub.add_parser("generate", help="write invented source files")
    gen.add_argument("--output", required=True)
    gen.add_argument("--physicians", type=int, default=500)
    gen.add_argument("--seed", type=int, default=42)
    seed = sub.add_parser("seed", help="write a run's exports to a database")
    seed.add_argument("--run", required=True)
    seed.add_argument("--url")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("linkwright").getOrCreate()
    if a.command == "run":
        from linkwright.plans.pipeline import run as run_pipeline

        given = {k: v for k, v in (("match_threshold", a.match_threshold), ("non_match_threshold", a.non_match_threshold), ("max_cluster_size", a.max_cluster_size)) if v is not None}
        config = dataclasses.replace(ResolveConfig.from_env(), include_uncertain_matches=a.include_uncertain, use_soundex_blocking=not a.no_soundex, **given)
        print(json.dumps(run_pipeline(spark, a.data, a.output, config), indent=2))
    elif a.command == "generate":
        from linkwright.sources.synthetic import write_all

        write_all(spark, a.output, a.physicians, a.seed)
    else:
        from linkwright.config import database_url
        from linkwright.sources import readers, sinks

        tables, url = readers.load_exports(spark, a.run), a.url or database_url()
        sinks.insert_jdbc(sinks.seed_rows(tables["canonical_physicians"]), url, "canonical_physicians")
        if "influence_scores" in tables:
            sinks.insert_jdbc(sinks.seed_scores(tables["influence_scores"]), url, "influence_scores")


if __name__ == "__main__":
    main()
