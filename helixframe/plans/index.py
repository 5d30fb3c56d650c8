"""The index bundle: a folder of Parquet tables and a manifest, all read and written by Spark."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import DNA, Alphabet
from ..operators import backward
from ..operators.neighbors import annotate, check_parameters
from ..operators.suffix import bwt, c_array, occ_marks, sa_of_text
from ..operators.text import check_names, text_statistics, with_coordinates
from ..sources.readers import read_fasta

VERSION = 1
PARTS = ("alphabet", "seqs", "sa", "bwt", "c", "occ_mark")


def index_base(path: str) -> str:
    """The name of an index from that of one of its parts."""
    return re.sub(r"\.(?:sym|txt|sar|bwt|ann(?:\.\d+\.\d+)?)$", "", path)


@dataclass
class Index:
    spark: SparkSession
    base: str
    alphabet: Alphabet = DNA
    annotations: set[tuple[int, int]] = field(default_factory=set)

    def _path(self, part: str) -> str:
        return f"{self.base}/{part}"

    def table(self, part: str) -> DataFrame:
        return self.spark.read.parquet(self._path(part))

    def _write_manifest(self) -> None:
        """Each version of the manifest is a file of its own; the one with most annotations is the latest."""
        a = self.alphabet
        text = json.dumps({"version": VERSION, "groups": a.groups, "complements": a.complements, "default": a.default, "unknown": a.unknown, "annotations": sorted(self.annotations)})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(self._path("manifest"))

    @classmethod
    def build(cls, spark: SparkSession, fasta: str, base: str, alphabet: Alphabet = DNA, suffixes: bool = True, rate: int = backward.RATE) -> Index:
        """Reads a FASTA file and writes sequences, alphabet and, unless told otherwise, suffix array, BWT, counts and what searches read:
        blocks of the BWT with their counts, and one in `rate` positions of the suffix array."""
        return cls.build_from(read_fasta(spark, fasta), base, alphabet, suffixes, rate)

    @classmethod
    def build_from(cls, seqs: DataFrame, base: str, alphabet: Alphabet = DNA, suffixes: bool = True, rate: int = backward.RATE) -> Index:
        spark = seqs.sparkSession
        check_names(seqs)
        index = cls(spark, base, alphabet)
        with_coordinates(seqs, alphabet).write.parquet(index._path("seqs"))
        rows = [(i, g[0], g, alphabet.complement(i)) for i, g in enumerate(alphabet.groups)]
        spark.createDataFrame(rows, "code int, canonical string, characters string, complement int").coalesce(1).write.parquet(index._path("alphabet"))
        if suffixes:
            positions, sa = sa_of_text(index.table("seqs").select("seq_id", "name", "seq"), alphabet)
            sa.repartitionByRange("rank").sortWithinPartitions("rank").write.parquet(index._path("sa"))
            transform = bwt(positions, index.table("sa"))
            transform.repartitionByRange("rank").sortWithinPartitions("rank").write.parquet(index._path("bwt"))
            c_array(positions, alphabet).write.parquet(index._path("c"))
            occ_marks(index.table("bwt"), alphabet).write.parquet(index._path("occ_mark"))
            backward.occ_blocks(index.table("bwt"), index.table("occ_mark"), alphabet).write.parquet(index._path("occ_block"))
            backward.sampled(index.table("sa"), rate).repartitionByRange("rank").sortWithinPartitions("rank").write.parquet(index._path(f"sa_sample/rate={rate}"))
        index._write_manifest()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        base = index_base(path)
        try:
            texts = [json.loads(r.value) for r in spark.read.text(f"{base}/manifest").collect()]  # a line for each change
        except AnalysisException as e:
            raise ValueError(f"no index at {base}") from e
        last = max(texts, key=lambda m: len(m["annotations"]))
        if last["version"] != VERSION:
            raise ValueError(f"{base} has version {last['version']}")
        alphabet = Alphabet(tuple(last["groups"]), tuple(last["complements"]), last["default"], last["unknown"])
        return cls(spark, base, alphabet, {tuple(a) for m in texts for a in m["annotations"]})

    def add(self, k: int, tau: int) -> bool:
        """Writes the neighbour annotation for (k, tau); False if it is there."""
        check_parameters(k, tau)
        if (k, tau) in self.annotations:
            return False
        annotate(self.table("seqs"), k, tau, self.alphabet).write.parquet(self._path(f"ann/k={k}/tau={tau}"))
        self.annotations.add((k, tau))
        self._write_manifest()
        return True

    def annotation(self, k: int, tau: int) -> DataFrame:
        if (k, tau) not in self.annotations:
            raise ValueError(f"no annotation for k={k} and a distance of {tau}")
        return self.table(f"ann/k={k}/tau={tau}")

    def occurrences(self) -> backward.Occurrences:
        """What searches step through."""
        total = text_statistics(self.table("seqs")).first()["text_length"]
        return backward.Occurrences(self.table("occ_block"), self.table("c"), total, self.alphabet)

    def intervals(self, patterns: DataFrame, pattern_col: str = "pattern") -> DataFrame:
        """pattern, fp, rp, sz, dp of patterns of any lengths, by backward search."""
        return self.occurrences().pattern_intervals(patterns, pattern_col)

    def count(self, patterns: DataFrame, pattern_col: str = "pattern") -> DataFrame:
        """pattern, n: occurrences on both strands of patterns of any lengths."""
        return self.intervals(patterns, pattern_col).select("pattern", F.col("sz").alias("n"))

    def locate(self, patterns: DataFrame, pattern_col: str = "pattern") -> DataFrame:
        """pattern, pos, label of every occurrence of patterns of any lengths, by backward search and the sampled suffix array."""
        samples = self.table("sa_sample")  # the rate is in the folder's name
        steps = self.occurrences()
        return backward.locate(steps.pattern_intervals(patterns, pattern_col), steps, samples.select("rank", "pos"), self.table("seqs"), samples.select("rate").first()[0])

    def view(self) -> DataFrame:
        """part, item, value: what the index holds; each part is looked for by itself."""
        rows = [("alphabet", g[0], f"{g} complement {self.alphabet.character(self.alphabet.complement(i))}") for i, g in enumerate(self.alphabet.groups)]
        for part in PARTS:
            try:
                self.table(part)
                rows.append(("parts", part, "present"))
            except AnalysisException:
                rows.append(("parts", part, "missing"))
        rows += [("annotations", f"k={k}", f"tau={t}") for k, t in sorted(self.annotations)]
        stats = text_statistics(self.table("seqs"))
        named = stats.select(F.explode(F.array(*[F.struct(F.lit("text").alias("part"), F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in stats.columns])).alias("x")).select("x.*")
        seqs = self.table("seqs").select(F.lit("sequences").alias("part"), F.col("name").alias("item"), (F.col("len") - 1).cast("string").alias("value"))
        return self.spark.createDataFrame(rows, "part string, item string, value string").unionByName(named).unionByName(seqs)
