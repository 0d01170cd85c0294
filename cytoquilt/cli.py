"""Command line: convert, concat, inspect, bench, compare, pipeline. Exit code 1 on bad input."""

from __future__ import annotations

import argparse
import glob
import json
import sys
from dataclasses import fields

from .operators.benchstats import compared, table_text
from .plans import convert as C
from .plans import pipeline, querybench
from .session import build_session
from .sources.config import load_config, override
from .sources.readers import read_runs

RUN = "store string, format string, axis string, mode string, delivered string, nnz long, min_s double, median_s double, p95_s double, n_selected long, n_runs long, mean_run double"
NAMES = ("convert-h5ad", "convert-10x-h5", "concat-h5ads")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cytoquilt")
    sub = p.add_subparsers(dest="command", required=True)
    for name in NAMES:
        c = sub.add_parser(name)
        c.add_argument("--input" if name != NAMES[2] else "--inputs", dest="input", required=True, nargs=None if name != NAMES[2] else "+")
        c.add_argument("--output", required=True)
        c.add_argument("--config")
        c.add_argument("--overwrite", action="store_const", const=True)
        c.add_argument("--x-storage")
        c.add_argument("--backend")
        for n in ("x-row-chunk", "x-col-chunk", "sparse-flat-chunk", "cpus", "x-shard-factor"):
            c.add_argument(f"--{n}", type=int)
        c.add_argument("--backed", action="store_const", const=True)
        if name == NAMES[0]:
            c.add_argument("--sort-by", nargs="+")
        if name == NAMES[2]:
            c.add_argument("--obs-columns", nargs="+")
    c = sub.add_parser("inspect")
    c.add_argument("--store", required=True)
    c = sub.add_parser("bench")
    c.add_argument("--store", required=True)
    c.add_argument("--axis", choices=["row", "col"], default="row")
    c.add_argument("--mode", choices=["sequential", "random", "celltype"], default="sequential")
    c.add_argument("--count", type=int)
    c.add_argument("--obs-column")
    c.add_argument("--obs-value")
    c.add_argument("--format", choices=["native", "csr", "dense"], default="native")
    c.add_argument("--repeats", type=int, default=5)
    c.add_argument("--warmup", type=int, default=1)
    c.add_argument("--seed", type=int, default=0)
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("compare")
    c.add_argument("files", nargs="+")
    c.add_argument("--sort", default="median_s")
    c.add_argument("--md", action="store_true")
    c = sub.add_parser("pipeline")
    for f in fields(pipeline.Settings):
        kind = {"bool": lambda v: v.lower() in ("1", "true", "yes"), "int": int, "float": float}.get(f.type, str)
        c.add_argument("--" + f.name.replace("_", "-"), type=kind, default=f.default)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        spark = spark or build_session("cytoquilt-cli")
        if args.command in NAMES:
            flags = {k: v for k, v in vars(args).items() if k not in ("command", "input", "output", "config")}
            cfg = override(load_config(args.config), **flags)
            done = C.concat(spark, args.input, args.output, cfg) if args.command == NAMES[2] else C.convert(spark, args.input, args.output, cfg)
            for w in done:
                print(f"warning: {w}", file=sys.stderr)
            print(json.dumps(C.inspect(spark, args.output)))
        elif args.command == "inspect":
            print(json.dumps(C.inspect(spark, args.store)))
        elif args.command == "bench":
            r = querybench.run(spark, args.store, args.axis, args.mode, args.count, args.obs_column, args.obs_value, args.format, args.repeats, args.warmup, args.seed)
            print(json.dumps(r) if args.json else "\n".join(f"{k}: {v}" for k, v in r.items()))
            if r["scattered"]:
                print("warning: the selection is scattered; sort the store by what you query", file=sys.stderr)
        elif args.command == "compare":
            paths = [p for f in args.files for p in (glob.glob(f) or [f])]
            runs = read_runs(spark, paths, RUN)
            rows = [r.asDict() for r in compared(runs, args.sort, ["store", "_file"]).collect()]
            print(table_text(rows, ["store", "axis", "mode", "delivered", "nnz", "min_s", "median_s", "p95_s", "xslow", "_file"], args.md))
        else:
            s = pipeline.Settings(**{f.name: getattr(args, f.name) for f in fields(pipeline.Settings)})
            out = pipeline.run(spark, s)
            rows = [{"step": k, "wall_s": v} for k, v in out["steps"]]
            print(table_text([*rows, {"step": "total", "wall_s": sum(r["wall_s"] for r in rows)}], ["step", "wall_s"]))
    except (FileNotFoundError, ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
