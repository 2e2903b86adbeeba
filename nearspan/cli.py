"""Command line: compares two files, or times kernels."""

from __future__ import annotations

import argparse
import sys
import time
from statistics import median

import numpy as np

from nearspan.functions import batch
from nearspan.functions.scorers import SCORERS, Options


def read(path: str, encoding: str) -> str:
    """A whole file as symbols: text, or one symbol for each byte."""
    with open(path, "rb") as f:
        data = f.read()
    try:
        return data.decode("latin-1" if encoding == "binary" else encoding)
    except UnicodeDecodeError as e:
        raise ValueError(f"{path}: not {encoding} at byte {e.start}") from e


def compare(args: argparse.Namespace) -> str:
    name = {"local": "smith_waterman_normalized", "global": "needleman_wunsch_normalized"}[args.mode]
    options = Options(match=args.match, mismatch=args.mismatch, gap_open=args.gap_open, gap_extend=args.gap_extend)
    score = SCORERS[name].pairs([read(args.query, args.encoding)], [read(args.target, args.encoding)], options)[0]
    return f"{score:.17g}"


def benchmark(args: argparse.Namespace) -> str:
    rng = np.random.default_rng(args.seed)
    draw = lambda: ["".join(map(chr, rng.integers(97, 123, args.length))) for _ in range(args.pairs)]
    a, b = draw(), draw()
    lines = ["scorer,length,pairs,seconds,pairs_per_second"]
    for name in args.scorers or [s for s in SCORERS]:
        took = []
        for _ in range(args.passes):
            began = time.perf_counter()
            SCORERS[name].pairs(a, b)
            took.append(time.perf_counter() - began)
        lines.append(f"{name},{args.length},{args.pairs},{median(took):.6f},{args.pairs / median(took):.0f}")
    if args.format == "csv":
        return "\n".join(lines)
    rows = [line.split(",") for line in lines]
    widths = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="nearspan")
    commands = parser.add_subparsers(dest="command", required=True)
    files = commands.add_parser("compare", help="normalised alignment score of two files")
    files.add_argument("query")
    files.add_argument("target")
    files.add_argument("--mode", choices=("local", "global"), default="global")
    files.add_argument("--encoding", choices=("ascii", "utf8", "binary"), default="utf8")
    for name, value in (("match", 2), ("mismatch", -1), ("gap-open", -1), ("gap-extend", None)):
        files.add_argument(f"--{name}", type=int, default=value)
    timing = commands.add_parser("benchmark", help="median seconds of kernels on random strings")
    timing.add_argument("--scorers", nargs="*", choices=list(SCORERS))
    for name, value in (("length", 16), ("pairs", 20_000), ("passes", 3), ("seed", 1)):
        timing.add_argument(f"--{name}", type=int, default=value)
    timing.add_argument("--format", choices=("table", "csv"), default="table")
    args = parser.parse_args(argv)
    try:
        print(compare(args) if args.command == "compare" else benchmark(args))
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
