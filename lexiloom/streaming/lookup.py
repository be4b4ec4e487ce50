"""Queries that arrive as a stream, looked up in a static index micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.plans import search
from lexiloom.profiles import LanguageProfile


def seed_counts(stream: DataFrame, index: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """(window, id, score): how often the k-mers of arriving queries meet each entry, per five minutes.

    ``stream`` has ts and kmers; late rows beyond the watermark are dropped.
    """
    wanted = stream.withWatermark("ts", watermark).select("ts", F.explode("kmers").alias("kmer"))
    return wanted.join(index, "kmer").groupBy(F.window("ts", "5 minutes"), "id").agg(F.count("*").alias("score"))


def search_stream(stream: DataFrame, lexicon: DataFrame, profile: LanguageProfile, path: str, checkpoint: str, **options):
    """Search every micro-batch of (qid, query) and append the results to ``path``; returns the running query."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            search.search(batch.select("qid", "query"), lexicon, profile, **options).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
