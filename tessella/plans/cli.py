"""Command line: tile maps and cartograms from files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..operators import partition as partitioning
from . import evaluate
from .pipeline import Plan, area_weights, cartogram, export, random_weights, read_map, run, table_weights, write_map


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("map", help="partition, arrange, assign, combine")
    t.add_argument("-input", required=True)
    t.add_argument("-output", required=True)
    t.add_argument("-format", default="wkt", choices=("wkt", "ipe"))
    t.add_argument("-exportall", action="store_true", help="also GeoJSON, SVG and TSV")
    t.add_argument("-decompose", nargs=2, metavar=("P", "D"), help="productivity and dilation; without it outlines stay whole")
    t.add_argument("-cuts", default="COMBINED", choices=partitioning.CUT_TYPES)
    t.add_argument("-arrange", default="SQUARE", metavar="GRID")
    t.add_argument("-assign", default="Uniform-Agnostic")
    t.add_argument("-refine", choices=("Uniform-Aware", "Nonuniform-Aware"))
    t.add_argument("-combine", default="ClosestAssigned")
    c = sub.add_parser("cartogram", help="regions of given sizes")
    c.add_argument("-input", required=True)
    c.add_argument("-output", required=True)
    c.add_argument("-format", default="wkt", choices=("wkt", "ipe"))
    c.add_argument("-grid", default="SQUARE")
    c.add_argument("-weights", nargs="+", metavar="W", help="area LOW HIGH | random LOW HIGH | FILE FACTOR")
    c.add_argument("-exact", action="store_true")
    e = sub.add_parser("evaluate", help="run suites of experiments")
    e.add_argument("-input", required=True)
    e.add_argument("-select", default="pipeline", help="suites separated by ;")
    e.add_argument("-repetitions", type=int, default=3)
    e.add_argument("-outcomes", metavar="LOG", help="don't run anything: summarise the times in logs of earlier runs")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    if a.command == "evaluate" and a.outcomes:
        for r in evaluate.outcomes(spark.read.text(a.outcomes).withColumnRenamed("value", "line")).orderBy("suite", "settings", "step").collect():
            print(r.suite, r.settings, r.step, f"{r.avg_ms:.0f} ms", r["count"])
        return 0
    m = read_map(spark, a.input)
    if a.command == "map":
        p, d = a.decompose or (10, None)
        plan = Plan(grid=a.arrange, cut_type=a.cuts, dilation=d and float(d), productivity=int(p), alignment=a.assign, refine=a.refine, combination=a.combine)
        done = run(m, plan)
        write_map(done.map, a.output, a.format)
        if a.exportall:
            export(done.map, a.output)
        for stage, s in done.timings:
            print(f"{stage}: {1000 * s:.0f} ms")
    elif a.command == "cartogram":
        if a.weights:
            kind, *rest = a.weights
            if kind == "area":
                m = m.with_(outlines=area_weights(m.outlines, float(rest[0]), float(rest[1])))
            elif kind == "random":
                m = m.with_(outlines=random_weights(m.outlines, int(rest[0]), int(rest[1])))
            else:
                from ..sources.tsv import read_weights

                m = m.with_(outlines=table_weights(m.outlines, read_weights(spark, kind), float(rest[0]) if rest else 1.0))
        write_map(cartogram(m, a.grid, a.exact), a.output, a.format)
    else:
        for name in a.select.split(";"):
            print(*evaluate.timing_lines(evaluate.run_suite(m, name, a.repetitions), name), sep="\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
