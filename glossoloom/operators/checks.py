"""Integrity rules as violations (rule, key), and their enforcement before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as X
from .records import CONFIDENCES, EN_FORMS, EXCLUSION_REASONS, ZH_FORMS


class RuleViolation(ValueError):
    """Rows that break a rule; carries the rule's name but no row content."""

    def __init__(self, rule: str, count: int):
        super().__init__(f"{rule}: {count} rows")
        self.rule, self.count = rule, count


def enforce(violations: DataFrame) -> None:
    """Raise for the most frequent rule of a violations frame; an empty frame passes. Only counts reach the driver."""
    top = violations.groupBy("rule").count().orderBy(F.desc("count"), "rule").limit(1).collect()
    if top:
        raise RuleViolation(top[0]["rule"], top[0]["count"])


def _fired(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(hits).alias("rule")).select("rule", "key")


def segment_faults(segments: DataFrame) -> DataFrame:
    return _fired(segments, {"bad_id": F.col("id").isNull() | ~F.col("id").rlike(X.SEGMENT_ID), "bad_ordinal": (F.col("chapter") < 1) | (F.col("paragraph") < 1) | (F.col("sentence") < 1), "no_text": F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, "no_pages": F.coalesce(F.size("source_pages"), F.lit(0)) == 0}, "id")


def alignment_faults(alignments: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    return _fired(
        alignments,
        {
            "bad_id": ~F.col("align_id").rlike(r"^a\d+$"),
            "bad_confidence": F.col("confidence").isNull() | ~F.col("confidence").between(0, 1),
            "bad_margin": F.col("margin") < 0,
            "blank_language": (F.trim(F.coalesce("src_lang", F.lit(""))) == "") | (F.trim(F.coalesce("tgt_lang", F.lit(""))) == ""),
            "null_element": F.exists("src", lambda x: x.isNull()) | F.exists("tgt", lambda x: x.isNull()),
            "type_mismatch": F.col("type") != F.concat(n("src"), F.lit(":"), n("tgt")),
        },
        "align_id",
    )


def block_faults(blocks: DataFrame) -> DataFrame:
    return _fired(blocks, {"bad_confidence": ~F.col("confidence").between(0, 1), "bad_box": F.size("bbox") != 4, "bad_engine": ~F.col("engine").isin("paddleocr", "pymupdf")}, "block_id")


def coupling_faults(rows: DataFrame, key: str = "id") -> DataFrame:
    """Annotation values that contradict each other, for rows of trimmed text columns: (rule, key)."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = {
        "de_valid_invalid": ~F.col("de_valid").isin("include", "exclude"),
        "exclude_without_reason": (F.col("de_valid") == "exclude") & ~F.coalesce(F.col("de_exclusion_reason").isin(*EXCLUSION_REASONS), F.lit(False)),
        "include_with_reason": (F.col("de_valid") == "include") & ~blank("de_exclusion_reason"),
    }
    for lang, forms in (("en", EN_FORMS), ("zh", ZH_FORMS)):
        form, span, sure = F.coalesce(F.col(f"{lang}_form"), F.lit("")), f"{lang}_counterpart", f"{lang}_alignment_confidence"
        rules |= {
            f"{lang}_form_unknown": (form != "") & ~form.isin(*forms),
            f"{lang}_omitted_with_span": (form == "omitted") & ~blank(span),
            f"{lang}_uncertain_without_note": (form == "uncertain") & blank(f"{lang}_notes"),
            f"{lang}_form_without_span": ~form.isin("", "omitted", "uncertain") & blank(span),
            f"{lang}_span_without_form": (form == "") & ~blank(span),
            f"{lang}_form_without_confidence": (form != "") & blank(sure),
            f"{lang}_confidence_unknown": ~blank(sure) & ~F.col(sure).isin(*CONFIDENCES),
        }
    return _fired(rows, rules, key)


def binding_faults(returned: DataFrame, master: DataFrame, columns: list[str], key: str = "id", digest: str = "row_hash") -> DataFrame:
    """Returned rows against the master by id: unknown, missing and repeated ids, other hashes, edited columns."""
    counted = returned.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    repeated = counted.filter("n > 1").select(F.lit("duplicate_id").alias("rule"), F.col(key).alias("key"))
    blank = counted.filter(F.coalesce(F.trim(key), F.lit("")) == "").select(F.lit("blank_id").alias("rule"), F.col(key).alias("key"))
    unknown = counted.filter(F.trim(key) != "").join(master.select(key).distinct(), key, "left_anti").select(F.lit("id_not_in_master").alias("rule"), F.col(key).alias("key"))
    missing = master.select(key).distinct().join(returned.select(key), key, "left_anti").select(F.lit("master_row_missing").alias("rule"), F.col(key).alias("key"))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    both = returned.select(key, *[F.col(c) for c in {*columns, digest}]).join(master.select(key, *[F.col(c).alias(f"_m_{c}") for c in {*columns, digest}]), key)
    edited = F.array_compact(F.array(*[F.when(text(c) != text(f"_m_{c}"), F.lit("row_hash_mismatch" if c == digest else f"edited_{c}")) for c in sorted({*columns, digest})]))
    changed = both.select(F.explode(edited).alias("rule"), F.col(key).alias("key"))
    return repeated.unionByName(blank).unionByName(unknown).unionByName(missing).unionByName(changed)


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: (key, side)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def manifest_gaps(expected: DataFrame, manifest: DataFrame, keys: list[str], good: tuple[str, ...] = ("ok", "zero_hits_ok")) -> DataFrame:
    """Expected jobs whose manifest entry is missing or has a bad status: (*keys, status)."""
    joined = expected.join(manifest.select(*keys, "status"), keys, "left")
    return joined.filter(F.col("status").isNull() | ~F.col("status").isin(*good)).select(*keys, F.coalesce("status", F.lit("missing")).alias("status"))


def context_regressions(cases: DataFrame, contexts: DataFrame) -> DataFrame:
    """Expected ids that the context lacks, unless it is marked for manual review: (key, missing)."""
    joined = cases.join(contexts, "key", "left")
    lacking = F.array_except("expected", F.coalesce("context_ids", F.array().cast("array<string>")))
    return joined.withColumn("missing", lacking).filter((F.size("missing") > 0) & (F.coalesce("provenance", F.lit("")) != "manual_review")).select("key", "missing")
