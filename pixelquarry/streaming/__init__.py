"""Streams of image files: binaryFile as a stream, decoded and processed by the same stateless transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import Chain
from ..sources import files


def read_stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(image_id, path, content) of new files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)
    return found.select(F.xxhash64("path").alias("image_id"), "path", "content")


def processed(stream: DataFrame, chain: Chain) -> DataFrame:
    """Decoded frames after a chain of kernels."""
    return chain.apply(files.decode(stream).filter("pixels IS NOT NULL"))
