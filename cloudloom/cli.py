"""Command line: cloudloom in.ply [-l LOD] [in2.ply -l 1 ...] out [--bundle] ..."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from cloudloom.operators.clouds import filter_harmonics
from cloudloom.plans.encode import encode, export_lods
from cloudloom.sources.ply import read_many


def parse(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cloudloom", description=__doc__)
    p.add_argument("--bundle", action="store_true")
    p.add_argument("--sh-iter", "--k-means-iter", dest="iterations", type=int, default=10)
    p.add_argument("--chunk-count", "-C", type=int, default=512)
    p.add_argument("--chunk-extent", "-X", type=float, default=16.0)
    p.add_argument("--filter-harmonics", "-H", type=int, default=-1)
    p.add_argument("--images", choices=["webp", "png"], default="webp")
    # paths and -l are taken in their order
    known, paths, rest, k = [], [], list(argv), 0
    while k < len(rest):
        a = rest[k]
        if a in ("-l", "--lod"):
            if not paths or k + 1 == len(rest):
                p.error(f"{a} needs an input before it and a number after it")
            try:
                paths[-1] = (paths[-1][0], int(rest[k + 1]))
            except ValueError:
                p.error(f"{rest[k + 1]} is not a level of detail")
            k += 2
        elif a.startswith("-"):
            flag = a == "--bundle" or "=" in a or a in ("-h", "--help")
            known += rest[k : k + 1 + (not flag)]
            k += 1 + (not flag)
        else:
            paths.append((a, None))
            k += 1
    args = p.parse_args(known)
    if len(paths) < 2:
        p.error("an input and an output are needed")
    args.inputs, args.output = [(path, lod or 0) for path, lod in paths[:-1]], paths[-1][0]
    if any(not 0 <= lod <= 255 for _, lod in args.inputs):
        p.error("levels of detail lie within 0..255")
    args.lods = len(args.inputs) > 1 or args.output.endswith(".json")
    if args.lods and args.bundle:
        p.error("levels of detail are not written as a bundle")
    return args


def main(argv: list[str] | None = None) -> int:
    import sys

    args, began = parse(sys.argv[1:] if argv is None else argv), time.time()
    spark = SparkSession.builder.appName("cloudloom").getOrCreate()
    try:
        cloud = filter_harmonics(read_many(spark, args.inputs), args.filter_harmonics)
        if args.lods:
            export_lods(cloud, args.output, args.chunk_count, args.chunk_extent, args.iterations, args.images)
        else:
            encode(cloud, args.output, args.bundle, args.iterations, args.images)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"{time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
