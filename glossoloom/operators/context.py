"""Retrieval context: windows around anchors, nearest aligned neighbours and brackets between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C


def corpus_order(segments: DataFrame) -> DataFrame:
    """(book, lang, chapter, id, text, pos): distinct segments in chapter order, of repeated ids the first loaded."""
    first = segments.groupBy("id").agg(F.min(F.struct("loaded_at", "chapter", "paragraph", "sentence", F.coalesce("text", F.lit("")).alias("text"))).alias("x"))
    rows = first.select("id", F.regexp_extract("id", r"^(.+)_[a-z]+_ch\d+_", 1).alias("book"), F.regexp_extract("id", r"^.+_([a-z]+)_ch\d+_", 1).alias("lang"), "x.chapter", "x.paragraph", "x.sentence", "x.text")
    pos = F.row_number().over(W.partitionBy("book", "lang", "chapter").orderBy("paragraph", "sentence", "id"))
    return rows.withColumn("pos", pos).drop("paragraph", "sentence")


def chapter_arrays(ordered: DataFrame) -> DataFrame:
    """(book, lang, chapter, ids): the ids of each chapter in order; a chapter is bounded by its book."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    return ordered.groupBy("book", "lang", "chapter").agg(ids.alias("ids"))


def window_ids(ids, anchors, width):
    """Ids from the first anchor minus ``width`` to the last plus ``width``, clamped; null if no anchor is in order."""
    at = F.filter(F.transform(C.col(anchors), lambda a: F.array_position(C.col(ids), a)), lambda p: p > 0)
    lo = F.greatest(F.array_min(at) - C.col(width), F.lit(1))
    hi = F.least(F.array_max(at) + C.col(width), F.size(C.col(ids)))
    return F.when(F.size(at) > 0, F.slice(C.col(ids), lo.cast("int"), (hi - lo + 1).cast("int")))


def bracket_ids(ids, before, after, cap: int):
    """Ids from the last of ``before`` to the first of ``after``; empty beyond ``cap``, reversed or without either."""
    lo = F.array_position(C.col(ids), F.try_element_at(C.col(before), F.lit(-1)))
    hi = F.array_position(C.col(ids), F.try_element_at(C.col(after), F.lit(1)))
    empty = F.array().cast("array<string>")
    lo = F.when(F.coalesce(lo, F.lit(0)) > 0, lo).otherwise(hi)
    hi = F.when(F.coalesce(hi, F.lit(0)) > 0, hi).otherwise(lo)
    fine = F.coalesce((lo > 0) & (hi >= lo) & (hi - lo + 1 <= cap), F.lit(False))
    return F.when(fine, F.slice(C.col(ids), lo.cast("int"), (hi - lo + 1).cast("int"))).otherwise(empty)


def nearest_anchors(rows: DataFrame, partition: list[str], order: str, anchors: str) -> DataFrame:
    """Add ``before`` and ``after``: the non-empty anchors of the nearest row on each side, not counting the row itself."""
    w = W.partitionBy(*partition).orderBy(order)
    have = F.when(F.coalesce(F.size(anchors), F.lit(0)) > 0, F.col(anchors))
    return rows.withColumn("before", F.last(have, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("after", F.first(have, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))


def first_records(alignments: DataFrame, src_lang: str, tgt_lang: str) -> DataFrame:
    """(segment_id, align_id, src, tgt, confidence) of a pair of languages, exploded by source id; of several the first loaded."""
    pair = alignments.filter((F.col("src_lang") == src_lang) & (F.col("tgt_lang") == tgt_lang))
    rows = pair.select(F.explode(F.array_compact("src")).alias("segment_id"), "loaded_at", "align_id", "src", F.array_compact("tgt").alias("tgt"), "confidence")
    return rows.groupBy("segment_id").agg(F.min(F.struct("loaded_at", "align_id", "src", "tgt", "confidence")).alias("x")).select("segment_id", "x.align_id", "x.src", "x.tgt", "x.confidence")


def side_context(segments: DataFrame, alignments: DataFrame, src_lang: str, tgt_lang: str, *, window: int = 1, wide: int = 3, cap: int = 6, low: float = 0.5) -> DataFrame:
    """Context of each source segment: (segment_id, context_ids, provenance).

    Anchored segments take the window around their anchors, the wide one where the record merges source segments,
    the text looks undersegmented or confidence is low; others the bracket of their neighbours' anchors, if short
    enough, else none with ``manual_review``.
    """
    ordered = corpus_order(segments)
    source = ordered.filter(F.col("lang") == src_lang).select("book", "chapter", "pos", F.col("id").alias("segment_id"), "text")
    arrays = chapter_arrays(ordered.filter(F.col("lang") == tgt_lang)).select("book", "chapter", "ids")
    rows = source.join(first_records(alignments, src_lang, tgt_lang), "segment_id", "left").join(arrays, ["book", "chapter"], "left")
    rows = rows.withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    rows = nearest_anchors(rows, ["book", "chapter"], "pos", "tgt")
    merge = F.coalesce(F.size("src") >= 2, F.lit(False))
    doubtful = C.undersegmented("text") | F.coalesce(F.col("confidence") < low, F.lit(False))
    rows = rows.withColumn("_w", F.when(merge | doubtful, wide).otherwise(window))
    around, between = window_ids("ids", "tgt", "_w"), bracket_ids("ids", "before", "after", cap)
    anchored = F.coalesce(F.size("tgt"), F.lit(0)) > 0
    ids = F.when(anchored, F.coalesce(around, F.array().cast("array<string>"))).otherwise(between)
    provenance = F.when(anchored, F.when(merge, "merge_widened").when(doubtful, "heuristic_widened").otherwise("anchor_window")).otherwise(F.when(F.size(between) > 0, "neighbor_fallback").otherwise("manual_review"))
    return rows.select("segment_id", ids.alias("context_ids"), provenance.alias("provenance"))


def texts_of(rows: DataFrame, segments: DataFrame, key: str, ids: str, out: str = "texts") -> DataFrame:
    """(key, out): texts of an array of ids in its order, missing and empty ones left out, joined by blanks."""
    known = corpus_order(segments).select(F.col("id").alias("_id"), F.col("text").alias("_text"))
    parts = rows.select(key, F.posexplode_outer(ids).alias("_pos", "_id")).join(known, "_id", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.length("_text") > 0, F.struct("_pos", "_text"))))
    return parts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["_text"]), " ").alias(out))
