"""References to records that do not exist.

Composite keys with partial nulls are handled by their null mask: references are split by which key columns are null,
and each mask is anti-joined on its non-null columns only, under declared match semantics as in SQL foreign keys:

* ``simple``: a reference with any null column refers to nothing and is never an orphan;
* ``partial``: the non-null columns must occur together in some target row; an all-null reference is no orphan;
* ``full``: either all columns are null (no orphan) or none; a mixed reference is an orphan outright.

Existence can depend on time: a target row counts in period P when it was loaded in P or before and not deleted in P
or before. Each distinct target key keeps only its distinct (loaded, deleted) period pairs, so a key repeated
without bound still makes one short row.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import skew_safe_left_join

MATCHES = ("simple", "partial", "full")


def month_index(ts: str):
    """Months since year 0 as an integer; null stays null."""
    return (F.year(ts) * 12 + F.month(ts)).cast("int")


def month_text(index: str):
    """``YYYY-MM`` of a :func:`month_index`."""
    return F.format_string("%04d-%02d", ((F.col(index) - 1) / 12).cast("int"), (F.col(index) - 1) % 12 + 1)


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    keys: list[tuple[str, str]],
    *,
    match: str = "simple",
    period: str | None = None,
    loaded: str | None = None,
    deleted: str | None = None,
) -> DataFrame:
    """Rows of ``refs`` whose key names no row of ``targets``; all columns of ``refs``, repeated rows kept.

    ``keys`` pairs reference with target columns. With ``period`` (a whole number in ``refs``) existence is judged at
    the end of that period by the whole-number columns ``loaded`` and ``deleted`` of ``targets``: a row with null
    ``loaded`` never existed, null ``deleted`` means never deleted, and a reference with null ``period`` is judged at
    the end of time. An empty ``targets`` makes every checked reference an orphan. Names of the two tables may clash
    and further columns are allowed, since only renamed copies of the needed target columns are joined.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    ref_cols = [r for r, _ in keys]
    at = F.coalesce(F.col(period), F.lit(2**31 - 1)) if period else F.lit(2**31 - 1)
    found = []
    for mask in product((True, False), repeat=len(keys)):
        kept = [k for k, present in zip(keys, mask) if present]
        if not kept or (match == "simple" and not all(mask)):
            continue
        here = reduce(lambda a, b: a & b, [F.col(c).isNotNull() if m else F.col(c).isNull() for c, m in zip(ref_cols, mask)])
        part = refs.filter(here)
        if match == "full" and not all(mask):
            found.append(part)
            continue
        names = [f"__orphan_k{i}" for i in range(len(kept))]
        probe = part.select("*", *[F.col(r).alias(n) for (r, _), n in zip(kept, names)])
        alive = (
            targets.select(
                *[F.col(t).alias(n) for (_, t), n in zip(kept, names)],
                (F.col(loaded) if loaded else F.lit(0)).alias("_from"),
                F.coalesce(F.col(deleted), F.lit(2**31 - 1)).alias("_until") if deleted else F.lit(2**31 - 1).alias("_until"),
            )
            .filter(F.col("_from").isNotNull() & reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))
            .groupBy(*names)
            .agg(F.collect_set(F.struct("_from", "_until")).alias("__orphan_spans"))
        )
        joined = skew_safe_left_join(probe, alive, names)
        exists = F.exists("__orphan_spans", lambda s: (s["_from"] <= at) & ((s["_until"] > at) | (s["_until"] == 2**31 - 1)))
        found.append(joined.filter(~F.coalesce(exists, F.lit(False))).select(*[F.col(c) for c in refs.columns]))
    if not found:
        return refs.limit(0)
    return reduce(DataFrame.unionByName, found)


def corpus_references(alignments: DataFrame, occurrences: DataFrame, pp_mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references of the corpus to segments and to occurrences: two frames (ref_table, ref_field, ref_id, target_id, month).

    A null array has no elements, a null element or field is no reference, and a repeated delivery is one reference
    per month. Extra columns are ignored.
    """
    month = month_index("loaded_at").alias("month")
    sides = [
        alignments.select(
            F.lit("alignments").alias("ref_table"), F.lit(side).alias("ref_field"), F.col("align_id").alias("ref_id"), F.explode(side).alias("target_id"), month
        )
        for side in ("src", "tgt")
    ]
    to_segments = [*sides, occurrences.select(F.lit("occurrences").alias("ref_table"), F.lit("source_segment_id").alias("ref_field"), F.col("datapoint_id").alias("ref_id"), F.col("source_segment_id").alias("target_id"), month)]
    to_occurrences = pp_mappings.select(
        F.lit("pp_mappings").alias("ref_table"), F.lit("datapoint_id").alias("ref_field"), F.col("mapping_id").alias("ref_id"), F.col("datapoint_id").alias("target_id"), month
    )
    return reduce(DataFrame.unionByName, to_segments), to_occurrences


def corpus_orphans(segments: DataFrame, alignments: DataFrame, occurrences: DataFrame, pp_mappings: DataFrame) -> DataFrame:
    """Orphan references of the corpus: distinct (ref_table, ref_field, ref_id, target_id, period)."""
    to_segments, to_occurrences = corpus_references(alignments, occurrences, pp_mappings)

    def targets(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key).alias("key"), month_index("loaded_at").alias("loaded"), month_index("deleted_at").alias("deleted"))

    found = [
        orphan_references(refs, targets(df, key), [("target_id", "key")], period="month", loaded="loaded", deleted="deleted")
        for refs, df, key in ((to_segments, segments, "id"), (to_occurrences, occurrences, "datapoint_id"))
    ]
    return (
        found[0]
        .unionByName(found[1])
        .select("ref_table", "ref_field", "ref_id", "target_id", month_text("month").alias("period"))
        .distinct()
    )


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Number of orphan references and of distinct missing targets per table, field and period."""
    return orphans.groupBy("ref_table", "ref_field", "period").agg(
        F.count(F.lit(1)).alias("orphans"), F.countDistinct("target_id").alias("targets")
    )
