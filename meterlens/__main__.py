"""Run one report or a section and write the results.

    python -m meterlens credits_by_user --tables /data/telemetry --as-of 2024-02-15 --out /data/reports
    python -m meterlens idle_roles --database telemetry --as-of 2024-02-15 --out /data/reports
    python -m meterlens --section billing --tables /data/telemetry --as-of 2024-02-15 --out /data/reports
    python -m meterlens --section setup --tables /data/telemetry --inventory /data/listings --as-of 2024-02-15 --out /data/reports
"""

from __future__ import annotations

import argparse
import sys
from typing import get_args

from pyspark.sql import SparkSession

from .functions.time import as_datetime
from .plans import REPORTS
from .plans.catalog import SECTIONS, parameters, run_report, run_section
from .sources.inventory import inventory_tables
from .sources.tables import Tables


def _value(name: str, key: str, text: str):
    """``text`` as the type that the report's parameter is annotated with."""
    known = parameters(name)
    if key not in known:
        raise ValueError(f"report {name!r} has no parameter {key!r}")
    kinds = get_args(known[key].annotation) or (known[key].annotation,)
    if bool in kinds:
        return text.lower() in ("1", "true", "yes")
    for kind in (int, float):
        if kind in kinds and str not in kinds:
            try:
                return kind(text)
            except ValueError:
                continue
    return text


def main(argv: list[str] | None = None) -> int:
    """0 if every report was written, 1 if some were skipped."""
    ap = argparse.ArgumentParser(prog="meterlens", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    ap.add_argument("report", nargs="?", choices=sorted(REPORTS))
    ap.add_argument("--section", choices=sorted(SECTIONS))
    ap.add_argument("--tier", type=int, choices=[1, 2, 3], help="with --section: only reports of this tier")
    ap.add_argument("--one-scan", action="store_true", help="with --section: read each table once for the reports that group it")
    ap.add_argument("--inventory", help="folder of exported listings (warehouses, streams, parameters); the newest at --as-of is used")
    source = ap.add_mutually_exclusive_group(required=True)
    source.add_argument("--tables", help="folder of telemetry tables (one sub-folder per table)")
    source.add_argument("--database", help="catalog database holding the telemetry tables")
    ap.add_argument("--as-of", help="evaluation instant, ISO format")
    ap.add_argument("--param", action="append", default=[], help="report parameter as key=value")
    ap.add_argument("--out", required=True, help="output folder; one sub-folder per report")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    args = ap.parse_args(argv)
    if not args.report and not args.section:
        ap.error("give a report or --section")

    spark = SparkSession.builder.appName("meterlens").getOrCreate()
    t = Tables.from_parquet(spark, args.tables) if args.tables else Tables.from_catalog(spark, args.database)
    as_of = as_datetime(args.as_of) if args.as_of else None
    if args.inventory:
        t = t.replaced(inventory_tables(spark, args.inventory, as_of))
    params = dict(p.split("=", 1) for p in args.param)
    if args.report:
        typed = {k: _value(args.report, k, v) for k, v in params.items()}
        reports, skipped = {args.report: run_report(t, args.report, as_of, **typed)}, {}
    else:
        owner = {k: n for n in SECTIONS[args.section] for k in parameters(n)}
        unknown = sorted(set(params) - set(owner))
        if unknown:
            raise ValueError(f"no report of section {args.section!r} has a parameter {unknown}")
        reports = run_section(t, args.section, as_of, args.tier, one_scan=args.one_scan,
                              **{k: _value(owner[k], k, v) for k, v in params.items()})
        skipped = reports.skipped
    for name, df in reports.items():
        writer = df.write.mode("overwrite")
        if args.format == "csv":
            writer = writer.option("header", "true")
        writer.format(args.format).save(f"{args.out}/{name}")
        print(f"wrote {args.out}/{name}")
    for name, reason in skipped.items():
        print(f"skipped {name}: {reason}", file=sys.stderr)
    return 1 if skipped else 0


if __name__ == "__main__":
    sys.exit(main())
