"""Command line: list the queries, run one, show its plan, scan a corpus, score observations, decide transitions."""

from __future__ import annotations

import argparse
import json

from cairnflow.operators import readiness
from cairnflow.plans import catalogue, reports
from cairnflow.session import session
from cairnflow.sources import definitions


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cairnflow", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries")
    for name in ("run", "explain"):
        p = commands.add_parser(name)
        p.add_argument("query", choices=sorted(catalogue.QUERIES))
        p.add_argument("sf_dir")
        p.add_argument("--limit", type=int, default=20)
    p = commands.add_parser("extract")
    p.add_argument("folder", nargs="+")
    p.add_argument("--out", required=True)
    p = commands.add_parser("status")
    p.add_argument("observations", help="a Parquet table of process_id, observed_at, diverged, severity")
    p.add_argument("--now", required=True)
    p.add_argument("--html")
    p = commands.add_parser("advance")
    p.add_argument("observations")
    p.add_argument("config", help="a Parquet table of process_id, stage_percent, hash_seed, entered_stage_at")
    p.add_argument("--now", required=True)
    p.add_argument("--out", help="write the new configuration there")
    p.add_argument("--sign-off", nargs="*", default=[])
    a = parser.parse_args(argv)
    if a.command == "queries":
        print("\n".join(catalogue.QUERIES))
        return 0
    spark = session()
    if a.command == "run":
        catalogue.QUERIES[a.query](spark, a.sf_dir).show(a.limit, False)
    elif a.command == "explain":
        catalogue.QUERIES[a.query](spark, a.sf_dir).explain("formatted")
    elif a.command == "extract":
        found = definitions.files(spark, *a.folder)
        reports.write_extract(a.out, components=definitions.components(found), categories=definitions.category_counts(found))
    elif a.command == "status":
        board = reports.shadow_dashboard(spark.read.parquet(a.observations), a.now)
        print(json.dumps(board["scores"], indent=1))
        if a.html:
            with open(a.html, "w", encoding="utf-8") as out:
                out.write(reports.page("shadow", **board))
    else:
        config = spark.read.parquet(a.config)
        scores = readiness.readiness(readiness.in_window(spark.read.parquet(a.observations), a.now))
        decisions = readiness.decide(config, scores, a.now)
        decisions.show(1000, False)
        if a.out:
            readiness.apply_decisions(config, decisions, a.now, a.sign_off).write.parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
