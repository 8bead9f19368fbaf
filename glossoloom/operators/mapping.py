"""Candidates for the counterpart of a German phrase, scored by independent signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as X
from . import trees


def score_candidates(pairs: DataFrame, side: str) -> DataFrame:
    """Add ``signals`` array<struct<name, weight>> and ``score`` to (de_prep, de_surface, de_lemma, prep_surface, head_surface, head_lemma, head_upos, span_text, confidence).

    The position signal always fires, as one German phrase is compared at a time.
    """
    forms = F.create_map(*[x for k, v in X.PREP_FORMS[side].items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    names = F.array_union(C.capitalized_tokens("span_text"), F.when(F.col("head_upos") == "PROPN", F.array(F.lower("head_surface"))).otherwise(F.array().cast("array<string>")))
    fired = {
        "prep_semantic_match": F.array_contains(F.coalesce(F.try_element_at(forms, F.col("de_prep")), F.array().cast("array<string>")), F.lower("prep_surface")),
        "proper_name_overlap": F.size(F.array_intersect(C.capitalized_tokens("de_surface"), names)) > 0,
        "lemma_overlap": C.overlaps("de_lemma", "head_lemma"),
        "position_match": F.lit(True),
        "align_confidence_bonus": F.coalesce(F.col("confidence") > X.CONFIDENCE_BONUS[side], F.lit(False)),
    }
    signals = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(n).alias("name"), F.lit(X.SCORE_WEIGHTS[n]).alias("weight"))) for n, on in fired.items()]))
    return pairs.withColumn("signals", signals).withColumn("score", F.aggregate("signals", F.lit(0.0), lambda s, x: s + x["weight"]))


def spaced_phrases(words, side: str) -> Column:
    """Phrases of a list of words without a parse: array<struct<prep_surface, head_surface, head_lemma, head_upos, span_text>>.

    A word that can render a preposition opens a phrase, and the next word, over an article, is its head; a capital
    makes it a name.
    """
    forms = sorted({w for v in X.PREP_FORMS[side].values() for w in v})
    at = lambda i: F.try_element_at(words, i)

    def phrase(w, i):
        article = F.lower(at(i + 2)).isin("the", "a", "an")
        head = F.when(article, at(i + 3)).otherwise(at(i + 2))
        upos = F.when(head.rlike("^[A-Z]"), "PROPN").otherwise("NOUN")
        span = F.concat_ws(" ", w, F.when(article, at(i + 2)), head)
        return F.when(F.lower(w).isin(*forms) & head.isNotNull(), F.struct(w.alias("prep_surface"), head.alias("head_surface"), F.lower(head).alias("head_lemma"), upos.alias("head_upos"), span.alias("span_text")))

    return F.array_compact(F.transform(words, phrase))


def best_candidates(scored: DataFrame, keys: list[str], ordinal: str = "cand", keep: int = 4) -> DataFrame:
    """The best candidate and the next three of each key, with ``rank`` and the status of the best."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), ordinal)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).withColumn("status", C.match_status("score"))


def blocks_of_ids(rows: DataFrame, blocks: DataFrame, ids: str) -> DataFrame:
    """Rows (key, ``ids``) with all parse blocks of each id: (key, pos, segment_id, blocks array<struct<ord, sent_id, tokens>>).

    ``blocks`` hold (source_segment_id, ord, sent_id, tokens), ord giving their order in the document. An id without
    blocks has null ``blocks``, and an id named twice has its blocks twice.
    """
    index = blocks.filter("source_segment_id IS NOT NULL").groupBy("source_segment_id").agg(F.array_sort(F.collect_set(F.struct("ord", "sent_id", "tokens"))).alias("blocks"))
    named = rows.select("key", F.posexplode(ids).alias("pos", "segment_id"))
    return named.join(index.withColumnRenamed("source_segment_id", "segment_id"), "segment_id", "left")


def mapping_records(candidates: DataFrame, blocks: dict[str, DataFrame]) -> DataFrame:
    """One record per distinct candidate: the best counterpart of its phrase on each side, and the next three.

    ``candidates`` hold (datapoint_id, de_prep, de_surface, de_lemma) and per side {side}_ids, {side}_context_ids and
    {side}_confidence; ``blocks`` hold the parse blocks by side. The context ids are searched, or the ids where there
    are none. {side}_best_in_anchor tells if the best stands in a block of the ids; {side}_unresolved counts ids
    without blocks, not context ids.
    """
    out = candidates.dropDuplicates().withColumn("key", F.sha2(F.to_json(F.struct(*candidates.columns), {"ignoreNullFields": "false"}), 256))
    for side, parsed in blocks.items():
        none = F.array().cast("array<string>")
        rows = out.select("key", "de_prep", "de_surface", "de_lemma", F.coalesce(f"{side}_ids", none).alias("anchor"), F.coalesce(f"{side}_context_ids", none).alias("near"), F.col(f"{side}_confidence").alias("confidence"))
        rows = rows.withColumn("search", F.when(F.size("near") > 0, F.col("near")).otherwise(F.col("anchor")))
        missing = blocks_of_ids(rows, parsed, "anchor").groupBy("key").agg(F.count_if(F.col("blocks").isNull()).alias(f"{side}_unresolved"))
        searched = blocks_of_ids(rows, parsed, "search")
        seen = searched.groupBy("key").agg(F.sum(F.coalesce(F.size("blocks"), F.lit(0))).alias(f"{side}_seen"))
        each = searched.select("key", "pos", "segment_id", F.posexplode("blocks").alias("block", "b"))
        each = each.select("key", "pos", "segment_id", "block", F.col("b.sent_id").alias("sent_id"), F.col("b.tokens").alias("tokens"))
        phrases = each.select("key", "segment_id", "sent_id", "pos", "block", F.posexplode(trees.case_phrases("tokens")).alias("i", "p"))
        pairs = phrases.join(rows.drop("search", "near"), "key").select("*", "p.*", F.struct("pos", "block", "i").alias("cand"))
        scored = score_candidates(pairs, side).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key")))
        found = F.struct("rank", "score", "status", "signals", "segment_id", F.array_contains("anchor", F.col("segment_id")).alias("in_anchor"), "sent_id", F.col("p").alias("phrase"))
        best = best_candidates(scored, ["key"]).groupBy("key").agg(F.array_sort(F.collect_list(found)).alias("_found"), F.max("n").alias(f"{side}_candidates"))
        for part in (missing, seen, best):
            out = out.join(part, "key", "left")
        first = F.get("_found", F.lit(0))
        status = F.coalesce(first["status"], F.lit("unmappable"))
        reason = F.when(F.col("_found").isNull(), "no_pp_in_target_sentence").when(status == "unmappable", "best_score_below_threshold")
        out = out.withColumns({f"{side}_status": status, f"{side}_best_score": F.coalesce(first["score"], F.lit(0.0)), f"{side}_best": first, f"{side}_best_in_anchor": first["in_anchor"], f"{side}_alternatives": F.slice("_found", 2, 3), f"{side}_reason": reason}).drop("_found")
        out = out.fillna(0, [f"{side}_{c}" for c in ("unresolved", "seen", "candidates")])
    return out.drop("key")


def signal_counts(scored: DataFrame) -> DataFrame:
    """How many candidates each signal fired for: (signal, n)."""
    return scored.select(F.explode("signals").alias("s")).groupBy(F.col("s.name").alias("signal")).agg(F.count(F.lit(1)).alias("n"))


def status_table(mappings: DataFrame) -> DataFrame:
    """How often each pair of English and Chinese presence occurs, per chapter and in total (null chapter)."""
    state = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, "found").otherwise("none")
    rows = mappings.select("chapter", state("en_sentence_ids").alias("en"), state("zh_sentence_ids").alias("zh"))
    return rows.groupingSets([["chapter", "en", "zh"], ["en", "zh"]], "chapter", "en", "zh").agg(F.count(F.lit(1)).alias("n"))
