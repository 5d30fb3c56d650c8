"""Command line: index build, index add, index view, and mapping of reads."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession

from ..operators.mapping import map_reads
from ..operators.neighbors import MOST_TAU
from ..sources.readers import read_queries, sniff
from ..streaming.reads import chunk_counts, chunked
from .index import Index, index_base

VERSION = "0.1"


class _Once(argparse.Action):
    """An option that may be given once."""

    def __call__(self, parser, namespace, values, option_string=None):
        if getattr(namespace, f"_{self.dest}", False):
            parser.error(f"{option_string} is given twice")
        setattr(namespace, f"_{self.dest}", True)
        setattr(namespace, self.dest, values)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixframe", description="Index and search symbol sequences with Spark.")
    top.add_argument("-v", "--version", action="version", version=f"helixframe {VERSION}")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="build, extend or show an index").add_subparsers(dest="action", required=True)
    build = index.add_parser("build", help="index a FASTA file")
    build.add_argument("fasta")
    build.add_argument("-o", "--output", action=_Once, help="the index's folder (default: the file's name with .index)")
    add = index.add_parser("add", help="annotate the neighbours of k-mers")
    add.add_argument("index")
    add.add_argument("-k", "--kmer", type=int, required=True, action=_Once)
    add.add_argument("-d", "--distance", type=int, required=True, action=_Once, choices=range(1, MOST_TAU + 1))
    add.add_argument("-t", "--threads", type=int, default=1, action=_Once, help="cores of a local session")
    view = index.add_parser("view", help="show what an index holds")
    view.add_argument("index")
    mapping = commands.add_parser("map", help="place reads on an index's sequences, or print them")
    mapping.add_argument("index")
    mapping.add_argument("reads")
    mapping.add_argument("-k", "--kmer", type=int, default=0, help="seed length; without it the reads' sequences are printed")
    mapping.add_argument("-d", "--distance", type=int, default=1)
    return top


def _chunk_by_chunk(chunks: DataFrame) -> Iterator[str]:
    """The sequences of reads in order; before each chunk's its count goes to the standard error."""
    rows = chunks.orderBy("ord").select("seq").toLocalIterator()
    for chunk in chunk_counts(chunks).orderBy("chunk").toLocalIterator():
        print(f"read: {chunk.n} sequences.", file=sys.stderr)
        yield from (r.seq for r in islice(rows, chunk.n))


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.command == "index" and args.action == "add" and (args.kmer <= args.distance or args.threads < 1):
        parser().error("the distance is less than k, and there is a thread at least")
    spark = spark or SparkSession.builder.appName("helixframe").getOrCreate()
    try:
        if args.command == "map":
            index = Index.open(spark, args.index)
            reads = read_queries(spark, args.reads)
            if args.kmer:
                rows = map_reads(reads, index.table("seqs"), args.kmer, args.distance, alphabet=index.alphabet).orderBy("read").toLocalIterator()
                lines = ("\t".join(map(str, r)) for r in rows)
            else:
                lines = _chunk_by_chunk(chunked(reads, sniff(spark, args.reads)))
            for line in lines:
                print(line)
        elif args.action == "build":
            Index.build(spark, args.fasta, args.output or f"{args.fasta}.index")
        elif args.action == "add":
            if not Index.open(spark, index_base(args.index)).add(args.kmer, args.distance):
                print("this annotation is there already", file=sys.stderr)
                return 1
        else:
            for r in Index.open(spark, args.index).view().orderBy("part", "item").toLocalIterator():
                print(f"{r.part}\t{r.item}\t{r.value}")
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
