"""Audio files and catalogues as tables (inventory A1-A3)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions import signal

# File name endings of music.
SUFFIXES = (".mp3", ".m4a", ".wav", ".flac", ".ogg", ".aac", ".opus", ".wma")


def audio_files(spark: SparkSession, root: str) -> DataFrame:
    """Music files below a folder, contents included only if read (A3)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1)).isin(*SUFFIXES))


def wav_chunks(files: DataFrame, rate: int = 22_050, seconds: float = 60, overlap: float = 0.0) -> DataFrame:
    """(path, chunk_no, samples, lead): mono WAV samples in chunks of ``seconds`` (A1), never one row a file. The first ``lead`` samples
    are the last ``overlap`` seconds of the chunk before: drop them after filtering."""

    def read(batches):
        step = int(rate * seconds)
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for start, lead, x in signal.wav_pieces(content, rate, step, int(overlap * rate)):
                    yield pd.DataFrame({"path": [path], "chunk_no": [start // step], "samples": [x], "lead": [lead]})

    return files.select("path", "content").mapInPandas(read, "path string, chunk_no int, samples array<double>, lead int")


def catalogue(tracks: DataFrame, path: str = "filepath") -> DataFrame:
    """Catalogue rows with music paths (A2): null texts empty, blank paths left out."""
    filled = tracks.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in tracks.schema.fields])
    return filled.where((F.trim(path) != "") & F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)).isin(*SUFFIXES))
