"""From occurrences to the eligible pool: identity, gates and the pairing rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as X
from .skew import hot_keys, skew_safe_left_join

IDENTITY = ["chapter", "source_segment_id", "parse_block_id", "pp_token_start", "pp_token_end"]
CORE = ["form", "canonical_prep", "machine_head_lemma", "decision", "corrected_head_lemma"]


def first_of_identity(occurrences: DataFrame) -> DataFrame:
    """The first loaded row of each occurrence identity; ties are broken by id and the core fields."""
    order = W.partitionBy(*IDENTITY).orderBy("loaded_at", "datapoint_id", *[F.coalesce(c, F.lit("")) for c in CORE])
    return occurrences.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def identity_conflicts(occurrences: DataFrame) -> DataFrame:
    """Identities whose rows differ in a core field: (*IDENTITY, rows, variants)."""
    core = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in CORE])
    return occurrences.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(core).alias("variants")).filter("variants > 1")


def head_lemma():
    """Corrected lemma unless blank, else the machine's, else empty."""
    return F.coalesce(F.nullif("corrected_head_lemma", F.lit("")), "machine_head_lemma", F.lit(""))


def structural_gate():
    """Whether the determiner of an uncontracted phrase is an article: null where unknown; contractions pass."""
    return F.when(F.col("form") == "contracted", True).when(F.col("det_xpos").isNull() | F.col("det_deprel").isNull(), None).otherwise((F.col("det_xpos") == "ART") & (F.col("det_deprel") == "det"))


def eligible_pool(occurrences: DataFrame, reviewed_chapters: tuple[int, ...] = (1, 2, 3), prepositions: tuple[str, ...] = X.SHARED_PREPOSITIONS) -> DataFrame:
    """Occurrences with ``head_lemma``, ``eligible`` and ``pool_reason``, gates in their fixed order.

    Contracted occurrences outside the reviewed chapters are kept when an included uncontracted one has the same
    preposition and lemma. Rows of a pair that many hold stay where they are: see :func:`skew.skew_safe_left_join`.
    """
    named = occurrences.withColumn("prep", C.canonical_prep("canonical_prep")).withColumn("head_lemma", head_lemma())
    rows = first_of_identity(named)
    fits = F.coalesce(F.col("prep").isin(*prepositions), F.lit(False))
    pairs = rows.filter(fits & (F.col("form") == "uncontracted") & (F.col("decision") == "include") & F.coalesce(structural_gate(), F.lit(False))).select("prep", "head_lemma").distinct().withColumn("_paired", F.lit(True))
    joined = skew_safe_left_join(rows, pairs, ["prep", "head_lemma"], hot=hot_keys(named, ["prep", "head_lemma"]))
    reason = (
        F.when(~fits, "outside_inventory")
        .when(structural_gate().isNull(), "missing_structure")
        .when(~structural_gate(), "not_article")
        .when(F.col("decision") == "exclude", "excluded")
        .when(~F.coalesce(F.col("decision") == "include", F.lit(False)), "undecided")
        .when(F.col("form") == "uncontracted", "uncontracted_included")
        .when(F.col("chapter").isin(*reviewed_chapters), "contracted_reviewed")
        .when(F.col("_paired"), "contracted_paired")
        .otherwise("contracted_unpaired")
    )
    kept = ("uncontracted_included", "contracted_reviewed", "contracted_paired")
    return joined.withColumn("pool_reason", reason).withColumn("eligible", F.col("pool_reason").isin(*kept)).drop("_paired")


def funnel(pool: DataFrame) -> DataFrame:
    """Rows and eligible rows by reason and form."""
    return pool.groupBy("pool_reason", "form").agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("eligible"))


def groups_with_both_forms(occurrences: DataFrame) -> DataFrame:
    """Minimal pairs that occur contracted and uncontracted: (pair, contracted, uncontracted)."""
    pair = C.minimal_pair("canonical_prep", head_lemma())
    counts = occurrences.groupBy(pair.alias("pair")).agg(F.count_if(F.col("form") == "contracted").alias("contracted"), F.count_if(F.col("form") == "uncontracted").alias("uncontracted"))
    return counts.filter("contracted > 0 AND uncontracted > 0")


def pick_pilot(candidates: DataFrame, per_form: int) -> DataFrame:
    """``per_form`` rows of each form by tier: firsts of minimal pairs, then author matches, then the rest, in stable order.

    The first row of each pair and form is found by aggregation, and ranking keeps the best ``per_form`` of every task
    before they meet, so a pair or form that many rows hold is never gathered. ``candidates`` holds an identity once.
    """
    key = ["chapter", "source_segment_id", "parse_block_id", "pp_token_start", "pp_token_end", "datapoint_id"]
    rows = candidates.withColumn("_pair", C.minimal_pair("canonical_prep", head_lemma()))
    both = groups_with_both_forms(candidates).select(F.col("pair").alias("_of"))
    firsts = rows.groupBy("_pair", "form").agg(F.min(F.struct(*key)).alias("_first")).join(both, F.col("_pair") == F.col("_of"), "left_semi").select(*[F.col(f"_first.{k}").alias(f"_{k}") for k in key], F.col("form").alias("_form"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*key, "form"]]
    rows = rows.join(firsts.withColumn("_is_first", F.lit(True)), reduce(lambda a, b: a & b, same), "left")
    rows = rows.withColumn("tier", F.when(F.col("_is_first"), "minimal_pair").when(F.col("inventory_eligible"), "author_match").otherwise("stable_fill"))
    rank = F.when(F.col("tier") == "minimal_pair", 1).when(F.col("tier") == "author_match", 2).otherwise(3)
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("form").orderBy(rank, *key))).filter(F.col("_r") <= per_form).select(*candidates.columns, "tier")
