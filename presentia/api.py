"""Entry points: run over files, an index of markers, a finder, and the matrix it gives."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presentia.functions import dna
from presentia.operators import matrix
from presentia.sources import readers, writers


def run(spark: SparkSession, genomes: str, markers: str, output: str | None = None, strategy: str = "auto", ordered: bool = False) -> DataFrame:
    """(genome_id, name, bits) for the genomes of a manifest and a marker CSV, written as "name bits" lines if ``output`` is given."""
    bits = MarkerIndex(readers.read_markers(spark, markers)).match(readers.read_genomes(spark, genomes), strategy)
    if output:
        writers.write_result(bits, output, ordered)
    return bits


def analyze(spark: SparkSession, genomes: Sequence[str], markers: Sequence[str]) -> list[str]:
    """The bit strings of a few genomes in memory, in their order."""
    bits = MarkerIndex(readers.markers_from(spark, markers)).match(readers.genomes_from(spark, genomes))
    return [r.bits for r in bits.orderBy("genome_id").collect()]


@dataclass(frozen=True)
class Marker:
    """A marker in memory; its id is a whole number."""

    marker_id: int
    sequence: str
    phenotype: str | None = None

    def __post_init__(self):
        if not isinstance(self.marker_id, int) or isinstance(self.marker_id, bool):
            raise TypeError("a marker's id is an int")


class MarkerIndex:
    """An ordered marker table (ordinal, marker_id, seq), fixed once built."""

    def __init__(self, markers: DataFrame, strict: bool = False, case_insensitive: bool = False):
        if case_insensitive:
            markers = markers.withColumn("seq", F.upper("seq"))
        self.markers = markers
        if strict and (bad := markers.where(~matrix.dna.is_valid_marker(F.col("seq"))).select("ordinal").head(1)):
            raise ValueError(f"marker {bad[0].ordinal} has letters other than A, C, G, T, or none")

    @classmethod
    def of(cls, spark: SparkSession, markers: Sequence[Marker | str], **how) -> MarkerIndex:
        made = [m if isinstance(m, Marker) else Marker(i + 1, m) for i, m in enumerate(markers)]
        return cls(readers.markers_from(spark, [m.sequence for m in made], [m.marker_id for m in made]), **how)

    def match(self, genomes: DataFrame, strategy: str = "auto") -> DataFrame:
        """``genomes`` (genome_id, name, seq) with bits instead of seq."""
        return matrix.presence_bits(genomes, self.markers, strategy)

    def persist(self) -> MarkerIndex:
        self.markers = self.markers.persist()
        return self

    def clear(self) -> None:
        self.markers.unpersist()


class PresenceMatrix:
    """Bits by genome and marker, unchangeable; operations give new ones."""

    def __init__(self, bits: DataFrame, markers: DataFrame):
        self.bits, self._markers = bits, markers

    def check(self) -> PresenceMatrix:
        if again := matrix.repeated_genomes(self.bits).head(1):
            raise ValueError(f"genome {again[0].name} occurs {again[0].n} times")
        return self

    @property
    def genomes(self) -> DataFrame:
        return self.bits.select("genome_id", "name").orderBy("genome_id")

    @property
    def markers(self) -> DataFrame:
        return self._markers.orderBy("ordinal")

    @property
    def marker_number(self) -> int:
        return self._markers.count()

    def marker_column(self, ordinal: int) -> DataFrame:
        return matrix.marker_column(self.bits, ordinal)

    def cell(self, name: str, ordinal: int) -> int:
        """0 or 1; an unknown genome or marker is an error."""
        found = self.bits.where(F.col("name") == name).select(F.substring(F.col("bits"), ordinal + 1, 1).alias("x")).head(1)
        if not found or ordinal < 0 or not found[0].x:
            raise KeyError((name, ordinal))
        return int(found[0].x)

    def add(self, hits: DataFrame) -> PresenceMatrix:
        """With the cells (genome_id, ordinal) set to 1 as well."""
        new = hits.groupBy("genome_id").agg(F.collect_set(F.col("ordinal").cast("int")).alias("_new"))
        both = dna.bits_of(F.array_union(dna.ones_of(F.col("bits")), F.col("_new")), F.lit(self.marker_number))
        bits = self.bits.join(new, "genome_id", "left").withColumn("bits", F.when(F.col("_new").isNull(), F.col("bits")).otherwise(both))
        return PresenceMatrix(bits.drop("_new"), self._markers)

    def reset(self) -> PresenceMatrix:
        """All zeros."""
        return PresenceMatrix(self.bits.withColumn("bits", F.repeat(F.lit("0"), self.marker_number)), self._markers)

    def save(self, path: str) -> None:
        writers.save_matrix(self.bits, f"{path}/bits")
        writers.save_matrix(self._markers, f"{path}/markers")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PresenceMatrix:
        return cls(writers.load_matrix(spark, f"{path}/bits"), writers.load_matrix(spark, f"{path}/markers"))


class MarkerFinder:
    """Holds genomes and markers and their matrix, which Spark keeps once it is computed; setting either forgets it."""

    def __init__(self, markers: DataFrame | None = None, genomes: DataFrame | None = None, strategy: str = "auto"):
        self._markers, self._genomes, self.strategy, self._matrix = markers, genomes, strategy, None

    @property
    def markers(self) -> DataFrame | None:
        return self._markers

    @markers.setter
    def markers(self, value: DataFrame) -> None:
        self.clear_state()
        self._markers = value

    @property
    def genomes(self) -> DataFrame | None:
        return self._genomes

    @genomes.setter
    def genomes(self, value: DataFrame) -> None:
        self.clear_state()
        self._genomes = value

    def clear_state(self) -> None:
        if self._matrix is not None:
            self._matrix.bits.unpersist()
        self._matrix = None

    def run(self) -> PresenceMatrix:
        if self._markers is None or self._genomes is None:
            raise ValueError("set markers and genomes first")
        if self._matrix is None:
            self._matrix = PresenceMatrix(MarkerIndex(self._markers).match(self._genomes, self.strategy).persist(), self._markers)
        return self._matrix

    @property
    def presence_matrix(self) -> PresenceMatrix:
        if self._matrix is None:
            raise ValueError("run() comes first")
        return self._matrix
