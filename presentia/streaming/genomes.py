"""An extension: genomes that arrive as files, matched as a stream against a fixed marker table.

Each genome's row is complete in itself, so the query keeps no state and needs no
watermark; the markers are the static side of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presentia.functions import dna
from presentia.operators import matching, matrix
from presentia.plans import planner


def read_genome_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """(name, seq) of the files that appear in a folder, plain or FASTA."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder, wholetext=True)
    return files.select(dna.basename(F.col("_metadata.file_path")).alias("name"), dna.normalise(dna.clean_fasta(F.col("value"))).alias("seq"))


def hits_stream(genomes: DataFrame, markers: DataFrame, stride: int = matching.STRIDE) -> DataFrame:
    """(genome_id, seq) of a stream of (genome_id, seq): append mode, a genome's hit perhaps more than once.

    The marker table must be small enough to broadcast; a larger one belongs in
    ``write_bits``, which matches each micro-batch by the planner's choice.
    """
    wanted = matching.distinct_markers(markers)
    stats = planner.statistics(wanted)
    if sum(s["n"] for s in stats.values()) > matching.BROADCAST_MARKERS or sum(s["bases"] for s in stats.values()) > matching.BROADCAST_BASES:
        raise ValueError("too many markers to broadcast; use write_bits")
    longest = max((s["most"] for s in stats.values()), default=1)
    pieces = matching.chunks(genomes, longest, stride, spread=False)
    return pieces.join(F.broadcast(wanted.select("seq")), F.expr("contains(chunk, seq)")).select("genome_id", "seq")


def write_bits(genomes: DataFrame, markers: DataFrame, out: str, checkpoint: str, strategy: str = "auto"):
    """A running query that appends (name, bits) of each micro-batch to Parquet in ``out``, a folder for each batch."""

    def batch(rows: DataFrame, number: int) -> None:
        named = rows.withColumn("genome_id", F.col("name"))
        bits = matrix.presence_bits(named, markers, strategy).select("name", "bits")
        bits.write.mode("overwrite").parquet(f"{out}/batch={number}")  # written again, not twice, after a failure

    return genomes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
