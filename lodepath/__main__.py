"""python -m lodepath ingest|stats|search|export ...; only here is anything printed."""

from __future__ import annotations

import argparse
import json
import sys

from .errors import IngestError, ScrapeError, StatsUnavailable


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodepath")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("json_dir"), a.add_argument("out_dir"), a.add_argument("--limit", type=int), a.add_argument("--full", action="store_true"), a.add_argument("--json", action="store_true")
    a = sub.add_parser("stats")
    a.add_argument("out_dir")
    a = sub.add_parser("search")
    a.add_argument("out_dir"), a.add_argument("query"), a.add_argument("--limit", type=int, default=20), a.add_argument("--offset", type=int, default=0), a.add_argument("--description", action="store_true")
    a = sub.add_parser("export")
    a.add_argument("out_dir"), a.add_argument("target"), a.add_argument("--format", choices=("parquet", "jsonl", "sqlite"), default="parquet")
    args = p.parse_args(argv)
    from .operators import stats
    from .plans.ingest import report, run_ingest
    from .session import session
    from .sources import sinks
    from .sources.snapshot import Snapshots

    spark = session()
    try:
        if args.what == "ingest":
            # errors of single files are counted, not raised: they do not make the run fail
            result = run_ingest(spark, args.json_dir, args.out_dir, args.limit, args.full, lambda m: print(m, file=sys.stderr))
            print(result.line() if args.json else report(result))
            return 0
        jobs = Snapshots(spark, args.out_dir).read("jobs")
        if args.what == "stats":
            print(json.dumps(stats.summary(jobs), default=lambda x: {k: getattr(x, k) for k in x.__slots__}, indent=1, ensure_ascii=False))
        elif args.what == "search":
            page = stats.get_page(jobs, args.query, args.limit, args.offset, args.description)
            print(json.dumps({"total": page.total, "rows": page.rows}, indent=1, ensure_ascii=False))
        else:
            {"parquet": sinks.write_parquet, "jsonl": sinks.write_jsonl, "sqlite": sinks.write_sqlite}[args.format](jobs, args.target)
        return 0
    except (IngestError, ScrapeError, StatsUnavailable, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
