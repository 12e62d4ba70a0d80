"""Indexing a working tree from the command line: ``spark-submit lithograph/index_job.py --path ... --out ...`` (SC21).

The graph is written as one version below ``--out`` and the repository's row
beside it. Parameters are checked before anything is read (SC17).
"""

from __future__ import annotations

import argparse
import re
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lithograph.schemas import NODES
from lithograph.sources import merge
from lithograph.sources.tree import adr_files, source_files
from lithograph.streaming import build
from lithograph.tables import checkpointed

#: Least and greatest depth of history, and lengths of a commit's name.
DEPTH, SHA = (1, 10_000), (7, 40)


def depth(text: str) -> int:
    """A depth of history within its bounds."""
    if not text.isdigit() or not DEPTH[0] <= int(text) <= DEPTH[1]:
        raise argparse.ArgumentTypeError(f"a number from {DEPTH[0]} to {DEPTH[1]} expected")
    return int(text)


def sha(text: str) -> str:
    """The name of a commit, whole or shortened."""
    if not re.fullmatch(rf"[0-9a-fA-F]{{{SHA[0]},{SHA[1]}}}", text):
        raise argparse.ArgumentTypeError(f"{SHA[0]} to {SHA[1]} hexadecimal digits expected")
    return text


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    """The job's parameters; wrong ones end the program with a message."""
    parser = argparse.ArgumentParser(description="Build the graph of a working tree.")
    for name in ("path", "owner", "name", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--github-id", type=int, required=True)
    parser.add_argument("--installation-id", type=int, default=0)
    parser.add_argument("--default-branch", default="main")
    parser.add_argument("--head-sha", type=sha, default=None)
    parser.add_argument("--depth", type=depth, default=1000, help="kept for callers; history is an input here")
    parser.add_argument("--with-embeddings", action="store_true")
    out = parser.parse_args(argv)
    if out.with_embeddings:
        parser.error("embeddings need a provider: call lithograph.streaming.build.embedded from Python")
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, int]:
    """Builds and writes the graph; the number of rows of each table."""
    repository = f"{args.owner}/{args.name}"
    sources = source_files(spark, args.path).select("path", "content").unionByName(adr_files(spark, args.path).select("path", "content"))
    state = build.full_build(checkpointed(sources.select(F.lit(repository).alias("repository_id"), "path", "content")))
    merge.save_whole(state, args.out, merge.COMPACT)
    row = spark.createDataFrame([(repository, args.github_id, args.owner, args.name, args.installation_id, args.default_branch, args.head_sha)], NODES["repositories"].rsplit(", created_at", 1)[0])
    merge.save_whole({"repositories": row}, args.out, merge.COMPACT)
    return {name: df.count() for name, df in merge.open_version(spark, args.out, merge.COMPACT, build.TABLES).items()}


def main(argv: Sequence[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("index").getOrCreate()
    print(run(spark, args))
    return 0


if __name__ == "__main__":
    sys.exit(main())
