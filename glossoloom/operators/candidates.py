"""Candidate rows: occurrences with their sentence and their aligned counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .context import corpus_order, first_records, texts_of


def candidate_rows(occurrences: DataFrame, segments: DataFrame, alignments: DataFrame) -> DataFrame:
    """Occurrences with sentence text, canonical pair, and per target language ids, text, cardinality, status and confidence.

    Occurrences of unknown segments are left out; :func:`unresolved` lists them. A record with an empty target side
    still counts as aligned.
    """
    rows = occurrences.select("datapoint_id", "chapter", "form", "canonical_prep", "machine_head_lemma", "source_segment_id").distinct()
    rows = rows.join(corpus_order(segments).select(F.col("id").alias("source_segment_id"), F.col("text").alias("de_text")), "source_segment_id")
    for lang in ("en", "zh"):
        first = first_records(alignments, "de", lang)
        texts = texts_of(first, segments, "segment_id", "tgt", f"{lang}_text")
        side = first.join(texts, "segment_id", "left").select(
            F.col("segment_id").alias("source_segment_id"), F.col("tgt").alias(f"{lang}_ids"), f"{lang}_text", C.cardinality("src", "tgt").alias(f"{lang}_cardinality"), F.col("confidence").alias(f"{lang}_confidence"), F.lit("aligned").alias(f"{lang}_status")
        )
        rows = rows.join(side, "source_segment_id", "left").fillna({f"{lang}_status": "missing", f"{lang}_text": ""})
    return rows.withColumn("pair", C.minimal_pair(C.canonical_prep("canonical_prep"), F.coalesce("machine_head_lemma", F.lit(""))))


def unresolved(occurrences: DataFrame, segments: DataFrame) -> DataFrame:
    """Segment ids named by occurrences that no segment has: (source_segment_id, rows)."""
    known = segments.select(F.col("id").alias("source_segment_id")).distinct()
    return occurrences.filter("source_segment_id IS NOT NULL").groupBy("source_segment_id").agg(F.count(F.lit(1)).alias("rows")).join(known, "source_segment_id", "left_anti")


def candidate_summary(candidates: DataFrame) -> DataFrame:
    """Counts by form and chapter: rows, missing sides, one-to-many and many-to-one alignments."""
    many = lambda c, p: F.count_if(F.col(c).rlike(p))
    return candidates.groupBy("form", "chapter").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("en_status") == "missing").alias("en_missing"), F.count_if(F.col("zh_status") == "missing").alias("zh_missing"),
        many("en_cardinality", r"^1:[2-9]$").alias("en_one_to_many"), many("en_cardinality", r"^[2-9]:1$").alias("en_many_to_one"), F.count_distinct("pair").alias("pairs"),
    )
