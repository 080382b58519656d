"""The stateless operators on streams, and windowed word counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.clean import cleaned
from corpusloom.functions.normalize import normalised
from corpusloom.operators.codec import encoder
from corpusloom.operators.counts import clauses, surfaces
from corpusloom.operators.sentences import finished, sentences


def cleaned_sentences(stream: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Cleaned sentences of a stream of raw lines; the same expressions as in batch."""
    return sentences(stream.select(*keep, finished(cleaned(F.col(text))).alias("_clean")), "_clean", keep)


def encoded(stream: DataFrame, vocabulary, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    rows = stream.select(*keep, normalised(F.col(text)).alias("text")).where("text <> ''")
    return rows.withColumn("ids", encoder(vocabulary)("text"))


def windowed_words(stream: DataFrame, time: str, text: str = "text", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Word counts by event-time window; rows later than the watermark are dropped by the engine, its state stays bounded."""
    words = stream.withWatermark(time, late).select(time, F.explode(clauses(F.col(text))).alias("_c")).select(time, F.explode(surfaces(F.col("_c"))).alias("surface"))
    return words.groupBy(F.window(time, width).alias("window"), "surface").agg(F.count("*").alias("n"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there to a parquet folder and stop; exactly once by the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
