"""The corpus commands: each reads tables, runs its checks before any write, and writes its result."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import columns as C
from ..functions import lexicons as X
from ..operators import align, audit, candidates, checks, clean, context, eligibility, mapping, records, references, segment, trees
from ..session import ship
from ..sources import files, sinks


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table from parquet, or from JSON lines of a known schema when the path says so."""
    ship(spark)
    return files.read_jsonl(spark, path, schema) if schema and path.rstrip("/").endswith((".jsonl", ".json")) else spark.read.parquet(path)


def save(df: DataFrame, out: str, force: bool) -> None:
    df.write.mode("overwrite" if force else "errorifexists").parquet(out)


def run_clean(spark, a):
    blocks = load(spark, a.blocks, S.OCR_BLOCK)
    checks.enforce(checks.block_faults(blocks))
    notes = (a.marker_size, a.note_size) if a.marker_size else None
    save(clean.clean(blocks, headers=a.header, min_confidence=a.min_confidence, notes=notes, opening_quotes={"de": "„", "en": "“", "zh": "“"}), a.out, a.force_output)


def run_segment(spark, a):
    paragraphs = load(spark, a.paragraphs, S.PARAGRAPH)
    save(segment.segments_of(paragraphs, {x: tuple(a.abbreviation) for x in ("de", "en")}), a.out, a.force_output)


def run_align(spark, a):
    ordered = context.corpus_order(load(spark, a.segments, S.SEGMENT).withColumn("loaded_at", F.lit(None).cast("timestamp")))
    coded = align.embed(ordered.withColumn("scope", F.format_string("%s_ch%02d", "book", "chapter")), align.HashEncoder())
    settings = align.with_settings(band=a.band)
    found = align.numbered(align.align_scopes(coded.filter(F.col("lang") == a.src), coded.filter(F.col("lang") == a.tgt), settings))
    save(found.select("align_id", "src", "tgt", F.lit(a.src).alias("src_lang"), F.lit(a.tgt).alias("tgt_lang"), "type", "confidence", "margin", F.lit("embedding_dp").alias("method"), "needs_review", F.lit(False).alias("validated")), a.out, a.force_output)


def run_extract(spark, a):
    """Phrases of parsed blocks, contracted or not, as the extraction table."""
    ship(spark)
    blocks = trees.parse_blocks(files.read_conllu(spark, a.parsed))
    faults = blocks.filter("sent_id IS NULL").select(F.lit("orphan_block").alias("rule"), F.lit("").alias("key"))
    checks.enforce(faults)
    forms = tuple(X.CONTRACTIONS) if a.form == "contracted" else X.PREPOSITIONS
    hits = blocks.withColumn("p", F.explode(trees.extract_phrases("tokens", forms, a.form == "contracted")))
    rows = hits.select(F.col("sent_id").alias("parse_block_id"), "source_segment_id", "p.*", trees.surface("tokens", "p.prep_token_id", "p.noun_token_id").alias("pp_surface"))
    rows = rows.withColumn("pp_token_start", F.col("prep_token_id")).withColumn("pp_token_end", F.col("noun_token_id"))
    sinks.write_tsv(rows.select(*[F.col(c).cast("string") for c in rows.columns]), a.out, "-", a.force_output)


def run_normalize(spark, a):
    """Multiword tokens collapsed, blocks written again."""
    ship(spark)
    blocks = trees.parse_blocks(files.read_conllu(spark, a.parsed)).withColumn("tokens", trees.collapse_ranges("tokens"))
    sinks.write_conllu(blocks.withColumn("block_text", trees.block_text("sent_id", "source_segment_id", "sent_text", "tokens")), a.out, overwrite=a.force_output)


def run_context(spark, a):
    save(context.side_context(load(spark, a.segments), load(spark, a.alignments), a.src, a.tgt), a.out, a.force_output)


def run_candidates(spark, a):
    occurrences, segments = load(spark, a.occurrences), load(spark, a.segments)
    lost = candidates.unresolved(occurrences, segments).select(F.lit("unresolved_segment").alias("rule"), F.col("source_segment_id").alias("key"))
    if not a.allow_missing:
        checks.enforce(lost)
    save(candidates.candidate_rows(occurrences, segments, load(spark, a.alignments)), a.out, a.force_output)


def run_pilot(spark, a):
    picked = eligibility.pick_pilot(eligibility.first_of_identity(load(spark, a.occurrences)), a.per_form)
    short = picked.groupBy("form").count().filter(F.col("count") < a.per_form).select(F.lit("pilot_underfilled").alias("rule"), F.col("form").alias("key"))
    checks.enforce(short)
    save(picked, a.out, a.force_output)


def run_annotation_csv(spark, a):
    sinks.write_annotation_csv(load(spark, a.rows).select(*[c for c in records.ANNOTATION_COLUMNS]), a.out, a.force_output)


def run_validate_csv(spark, a):
    """Rules that a returned file breaks, with counts; a file without any annotation passes its coupling rules."""
    back, master = files.read_returned_csv(spark, a.csv), load(spark, a.master)
    if back.columns != records.ANNOTATION_COLUMNS:
        raise checks.RuleViolation("header_mismatch", 1)
    filled = [c for c in records.ANNOTATOR_COLUMNS]
    template = back.select(F.bool_and(F.coalesce(F.trim(F.concat_ws("", *filled)), F.lit("")) == "").alias("t")).collect()[0].t
    faults = checks.binding_faults(back, master, list(records.MACHINE_COLUMNS[1:-1]))
    if not template:
        faults = faults.unionByName(checks.coupling_faults(back.select("id", *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in filled])))
    report = faults.groupBy("rule").count().orderBy("rule")
    report.show(100, False)
    checks.enforce(faults)


def run_pool(spark, a):
    occurrences = load(spark, a.occurrences)
    conflicts = eligibility.identity_conflicts(occurrences).select(F.lit("identity_conflict").alias("rule"), F.col("parse_block_id").alias("key"))
    if not a.keep_first:
        checks.enforce(conflicts)
    pool = eligibility.eligible_pool(occurrences)
    save(pool.filter("eligible"), a.out, a.force_output)
    eligibility.funnel(pool).orderBy("pool_reason", "form").show(100, False)


def run_score(spark, a):
    save(mapping.best_candidates(mapping.score_candidates(load(spark, a.pairs), a.side), ["datapoint_id"]), a.out, a.force_output)


def run_qc(spark, a):
    segments = load(spark, a.segments)
    save(audit.quality_issues(segments), a.out, a.force_output)
    audit.page_gaps(segments.withColumn("scope", C.scope_of("id")), ["scope"]).show(50, False)


def run_orphans(spark, a):
    tables = [load(spark, f"{a.folder}/{t}.parquet") for t in ("segments", "alignments", "occurrences", "pp_mappings")]
    save(references.corpus_orphans(*tables), a.out, a.force_output)


def run_impact(spark, a):
    save(audit.id_impact(load(spark, a.old), load(spark, a.new)), a.out, a.force_output)


def run_manifest(spark, a):
    """Manifest of a whole set of extraction tables; one that is not whole is an error and writes nothing."""
    ship(spark)
    chapters = range(1, a.chapters + 1)
    hits = files.read_extractions(spark, a.folder, chapters, a.book).groupBy("chapter", "form").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(1, a.chapters + 1).select(F.col("id").cast("int").alias("chapter"), F.explode(F.array(F.lit("contracted"), F.lit("uncontracted"))).alias("form"))
    jobs = grid.join(hits, ["chapter", "form"], "left").select("chapter", "form", F.when(F.col("n") > 0, "ok").otherwise("zero_hits_ok").alias("status"), F.coalesce("n", F.lit(0)).alias("row_count"), F.lit(None).cast("string").alias("error"))
    sinks.write_jsonl(sinks.manifest_rows(jobs), a.out, a.force_output)


def run_store(spark, a):
    """Segments as a store partitioned by language and chapter; malformed ids are an error."""
    rows = load(spark, a.segments)
    parts = C.segment_parts("id")
    checks.enforce(rows.filter(parts["lang"].isNull()).select(F.lit("malformed_id").alias("rule"), F.col("id").alias("key")))
    sinks.write_store(rows.drop("chapter").withColumns({"lang": parts["lang"], "chapter": parts["chapter"]}), a.out, overwrite=a.force_output)


#: Command, function, and its options: (name, keyword arguments).
COMMANDS = {
    "clean": (run_clean, [("blocks", {}), ("header", {"action": "append", "default": []}), ("min-confidence", {"type": float, "default": 0.4}), ("marker-size", {"type": float}), ("note-size", {"type": float, "default": 11.0})]),
    "segment": (run_segment, [("paragraphs", {}), ("abbreviation", {"action": "append", "default": []})]),
    "align": (run_align, [("segments", {}), ("src", {"default": "de"}), ("tgt", {"default": "en"}), ("band", {"type": float, "default": 0.15})]),
    "extract": (run_extract, [("parsed", {}), ("form", {"choices": ["contracted", "uncontracted"], "default": "contracted"})]),
    "normalize-mwt": (run_normalize, [("parsed", {})]),
    "context": (run_context, [("segments", {}), ("alignments", {}), ("src", {"default": "de"}), ("tgt", {"default": "en"})]),
    "candidates": (run_candidates, [("occurrences", {}), ("segments", {}), ("alignments", {}), ("allow-missing", {"action": "store_true"})]),
    "pilot": (run_pilot, [("occurrences", {}), ("per-form", {"type": int, "default": 40})]),
    "annotation-csv": (run_annotation_csv, [("rows", {})]),
    "validate-csv": (run_validate_csv, [("csv", {}), ("master", {})]),
    "pool": (run_pool, [("occurrences", {}), ("keep-first", {"action": "store_true"})]),
    "score": (run_score, [("pairs", {}), ("side", {"choices": ["en", "zh"], "default": "en"})]),
    "qc": (run_qc, [("segments", {})]),
    "orphans": (run_orphans, [("folder", {})]),
    "manifest": (run_manifest, [("folder", {}), ("book", {}), ("chapters", {"type": int, "default": 17})]),
    "store": (run_store, [("segments", {})]),
    "id-impact": (run_impact, [("old", {}), ("new", {})]),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glossoloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        c = sub.add_parser(name)
        for option, settings in options:
            c.add_argument(f"--{option}", **({"required": True} if not settings else settings))
        if name != "validate-csv":
            c.add_argument("--out", required=True)
        c.add_argument("--force-output", action="store_true")
    return p


def main(spark: SparkSession, args: list[str]) -> int:
    """Run one command; a broken rule or a bad source ends with 2 and its name, without row content."""
    a = parser().parse_args(args)
    try:
        COMMANDS[a.command][0](spark, a)
    except (checks.RuleViolation, files.SourceError) as e:
        print(e)
        return 2
    return 0
