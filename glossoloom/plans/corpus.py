"""Queries over segments, alignments, occurrences and mappings, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as X
from ..operators import align, audit, candidates, checks, clean, context, eligibility, mapping
from ..session import materialize, read_table, ship, spread
from . import cleaning
from .cleaning import NOTE_SIZES, OPENING, WS, _blocks

#: Vectors stand for sentences; a scope is a run of 500 vector ids of one label, so it keeps its size as vectors grow.
SCOPE = "concat(label, '_', vec_id div 500)"
PRECISION = 6


def _sides(spark, d):
    rows = read_table(spark, d, "embeddings").selectExpr(f"{SCOPE} AS scope", "vec_id AS pos", "cast(vec_id AS string) AS id", "embedding AS vector", "vec_id % 2 AS side")
    return rows.filter("side = 0").drop("side"), rows.filter("side = 1").drop("side")


def cosine_pairs(spark, d):
    """JOIN-16, FN-30: cosines of the pairs of a scope."""
    return align.pair_scores(*_sides(spark, d)).withColumn("score", F.round("score", PRECISION))


def ratio_margin(spark, d):
    """FN-31, WIN-12, SRT-05: ratio margins of the pairs of a scope."""
    rows = align.ratio_scores(align.pair_scores(*_sides(spark, d)))
    return rows.select("scope", "src_id", "tgt_id", F.round("ratio", 4).alias("ratio"))


def dp_align(spark, d):
    """PRC-04, FN-32, FN-33, FLT-26, FLT-27, AGG-20, WIN-16: banded dynamic program over scopes."""
    a, b = (x.withColumn("text", F.lit("x")) for x in _sides(spark, d))
    return align.numbered(align.align_scopes(a, b, align.AlignSettings()))


def two_pass_align(spark, d):
    """PRC-05, PRC-06, FLT-25, PRJ-14: the full alignment of chapters with anchors, encoded without a model."""
    ship(spark)
    known = {r.de_form: r.en_form for r in read_table(spark, d, "anchors").collect()}  # a fixed list
    order = context.corpus_order(read_table(spark, d, "segments")).withColumn("scope", F.format_string("%s_ch%02d", "book", "chapter"))
    coded = align.embed(order, align.HashEncoder()).withColumn("anchors", C.anchors_in("text", known))
    return align.numbered(align.align_scopes(coded.filter("lang = 'de'"), coded.filter("lang = 'en'")))


def align_summary(spark, d):
    """AGG-02, AGG-03, AGG-25: figures of alignment records by language pair."""
    rows = align.summary(read_table(spark, d, "alignments"), ["src_lang", "tgt_lang"])
    return rows.select(*[F.round(c, PRECISION).alias(c) if c.startswith("mean") or c.startswith("median") else F.col(c) for c in rows.columns])


def align_types(spark, d):
    """AGG-04: records by type and method."""
    return align.type_counts(read_table(spark, d, "alignments"))


def align_sources_twice(spark, d):
    """CHK-06, CHK-13, WIN-17: source segments in several records."""
    return align.sources_twice(read_table(spark, d, "alignments"))


def align_unknown_ids(spark, d):
    """JOIN-23, CHK-13: ids of alignment records that no segment has."""
    rows = read_table(spark, d, "alignments")
    ids = rows.select(F.lit("src").alias("side"), F.explode("src").alias("id")).unionByName(rows.select(F.lit("tgt").alias("side"), F.explode("tgt").alias("id")))
    return ids.filter("id IS NOT NULL").distinct().join(read_table(spark, d, "segments").select("id").distinct(), "id", "left_anti")


def agreement(spark, d):
    """JOIN-24, AGG-21, MSC-11: equal confidences at the same place in two language pairs of a chapter."""
    rows = read_table(spark, d, "alignments").filter("src_lang = 'de' AND size(src) > 0").withColumn("scope", C.scope_of(F.get("src", F.lit(0)))).filter("scope IS NOT NULL")
    pos = F.row_number().over(W.partitionBy("scope", "tgt_lang").orderBy("align_id", "loaded_at", F.to_json(F.struct("src", "tgt")), "confidence"))
    rows = rows.withColumn("pos", pos)
    out = align.positional_agreement(rows.filter("tgt_lang = 'en'"), rows.filter("tgt_lang = 'zh'"), ["scope"])
    return out.withColumn("agree_rate", F.round("agree_rate", PRECISION))


def legacy_normalize(spark, d):
    """PRJ-15: records of older runs in today's form."""
    rows = read_table(spark, d, "alignments").filter("tgt_lang = 'zh'").select("align_id", F.col("src").alias("en"), F.col("tgt").alias("zh"), F.lit("vecalign_labse").alias("method"), "confidence").distinct()
    return align.legacy_record(rows).select("align_id", F.array_join("src", ",").alias("src"), F.array_join("tgt", ",").alias("tgt"), "src_lang", "tgt_lang", "method", "confidence")


def _anchored(spark, d):
    known = {r.de_form: r.en_form for r in read_table(spark, d, "anchors").collect()}  # a fixed list
    rows = context.corpus_order(read_table(spark, d, "segments")).withColumn("scope", F.format_string("%s_ch%02d", "book", "chapter"))
    return rows.filter("lang IN ('de', 'en')").select("scope", "lang", "id", C.anchors_in("text", known).alias("anchors"))


def anchor_idf(spark, d):
    """AGG-13, FN-12, FN-34: weights of anchors by chapter."""
    return align.anchor_weights(_anchored(spark, d)).withColumn("weight", F.round("weight", PRECISION))


def anchor_bonus(spark, d):
    """JOIN-17, FN-35, SET-05: bonus of pairs that share an anchor."""
    rows = _anchored(spark, d)
    return align.anchor_bonus(rows.filter("lang = 'de'"), rows.filter("lang = 'en'"), 0.05, 0.15).withColumn("bonus", F.round("bonus", 5))


def side_context(spark, d):
    """PRC-14, JOIN-05..07, WIN-05, WIN-11, FLT-24, FN-40, CHK-16, SRC-14, SRC-15: English context of German segments."""
    return context.side_context(read_table(spark, d, "segments"), read_table(spark, d, "alignments"), "de", "en")


def ordered_texts(spark, d):
    """JOIN-03, JOIN-04: texts of the aligned English segments, in order."""
    segments = read_table(spark, d, "segments")
    return context.texts_of(context.first_records(read_table(spark, d, "alignments"), "de", "en"), segments, "segment_id", "tgt", "en_text")


def candidate_rows(spark, d):
    """PRC-15, JOIN-01, JOIN-02, PRJ-06, PRJ-08, PRJ-09, FLT-22, SRT-02: candidates with their sides."""
    return candidates.candidate_rows(*[read_table(spark, d, t) for t in ("occurrences", "segments", "alignments")])


def candidate_summary(spark, d):
    """AGG-05, AGG-06: candidates counted."""
    return candidates.candidate_summary(candidate_rows(spark, d))


def unresolved_segments(spark, d):
    """CHK-05: segments of occurrences that do not exist."""
    return candidates.unresolved(read_table(spark, d, "occurrences"), read_table(spark, d, "segments"))


def minimal_pairs(spark, d):
    """AGG-18, WIN-14, PRJ-06, PRJ-10: groups with both forms."""
    return eligibility.groups_with_both_forms(read_table(spark, d, "occurrences"))


def canonical_prep(spark, d):
    """PRJ-05, FN-45, FLT-19, SET-02: occurrences by canonical preposition and inventory."""
    rows = read_table(spark, d, "occurrences").withColumn("prep", C.canonical_prep("canonical_prep"))
    return rows.groupBy("prep", F.coalesce(F.col("prep").isin(*X.SHARED_PREPOSITIONS), F.lit(False)).alias("shared")).agg(F.count(F.lit(1)).alias("n"))


def form_distribution(spark, d):
    """AGG-24, FN-38: share of forms."""
    rows = read_table(spark, d, "occurrences").groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.join(F.broadcast(total), how="inner").select("form", "n", C.percentage("n", "total").alias("percent"))


def structural_gate(spark, d):
    """FLT-20, FLT-21: outcome of the structural gate."""
    rows = read_table(spark, d, "occurrences").withColumn("gate", F.coalesce(eligibility.structural_gate().cast("string"), F.lit("unknown")))
    return rows.groupBy("form", "gate").agg(F.count(F.lit(1)).alias("n"))


def dedup_identity(spark, d):
    """WIN-07, MSC-06: the first row of each occurrence identity."""
    rows = eligibility.first_of_identity(read_table(spark, d, "occurrences"))
    return rows.select("datapoint_id", "form", "decision", "loaded_at")


def identity_conflicts(spark, d):
    """CHK-07: identities with contradicting rows."""
    return eligibility.identity_conflicts(read_table(spark, d, "occurrences"))


def eligible_pool(spark, d):
    """PRC-18, JOIN-08, JOIN-11: the pool with reasons."""
    return eligibility.eligible_pool(read_table(spark, d, "occurrences")).select("datapoint_id", "head_lemma", "pool_reason", "eligible")


def pool_funnel(spark, d):
    """AGG-07, FN-46: the pool counted."""
    return eligibility.funnel(eligibility.eligible_pool(read_table(spark, d, "occurrences")))


def pilot_quota(spark, d):
    """SRT-06, PRC-16, WIN-14, CHK-18: a pilot of 40 rows of each form (a top-k report)."""
    rows = eligibility.first_of_identity(read_table(spark, d, "occurrences"))
    return eligibility.pick_pilot(rows, 40).select("datapoint_id", "form", "tier")


HASHED = ["datapoint_id", "chapter", "form", "canonical_prep", "machine_head_lemma", "inventory_eligible", "pp_token_start"]


def row_hash(spark, d):
    """PRJ-07, FN-42, FN-44: hash of source columns."""
    rows = read_table(spark, d, "occurrences").select(*HASHED).distinct()
    return rows.select("datapoint_id", C.row_hash(HASHED, dict(rows.dtypes)).alias("hash"))


def datapoint_ids(spark, d):
    """PRJ-04, MSC-08: ids built from their parts against those given."""
    rows = read_table(spark, d, "occurrences").distinct()
    built = C.datapoint_id("chapter", "parse_block_id", "pp_token_start", "pp_token_end")
    return rows.groupBy((built == F.col("datapoint_id")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


def mapping_crosstab(spark, d):
    """AGG-08: presence of counterparts per chapter and in total."""
    return mapping.status_table(read_table(spark, d, "pp_mappings"))


def _scored(spark, d):
    """Candidates for the counterpart of every mapped occurrence, from the texts of its English segments."""
    first = lambda t, key, *cs: read_table(spark, d, t).groupBy(key).agg(F.min(F.struct("loaded_at", *cs)).alias("x")).select(key, *[F.col(f"x.{c}") for c in cs])
    cases = first("pp_mappings", "datapoint_id", "mapping_id", "en_sentence_ids", "en_alignment_confidence")
    said = first("occurrences", "datapoint_id", "canonical_prep", "corrected_head_lemma", "machine_head_lemma")
    said = said.select("datapoint_id", C.canonical_prep("canonical_prep").alias("de_prep"), eligibility.head_lemma().alias("de_lemma"))
    texts = _orders(spark, d).select("id", F.regexp_extract_all("text", F.lit("[A-Za-z-]+"), F.lit(0)).alias("words"))
    named = cases.select("datapoint_id", F.col("en_alignment_confidence").alias("confidence"), F.posexplode("en_sentence_ids").alias("pos", "id")).join(texts, "id")
    found = named.select("datapoint_id", "confidence", "pos", F.posexplode(mapping.spaced_phrases(F.col("words"), "en")).alias("i", "p")).select("datapoint_id", "confidence", (F.col("pos") * 1000 + F.col("i")).alias("cand"), "p.*")
    return mapping.score_candidates(found.join(said, "datapoint_id").withColumn("de_surface", F.col("de_lemma")), "en")


def score_candidates(spark, d):
    """FN-13, FN-14, FN-36, FN-37, SET-07, WIN-15, SRT-03, SRT-04, JOIN-15, PRJ-13: scores, ranks and status of the candidates of mapped occurrences."""
    return mapping.best_candidates(_scored(spark, d), ["datapoint_id"]).select("datapoint_id", "cand", "score", "rank", "status")


def signal_counts(spark, d):
    """SRT-10: how often each signal fired."""
    return mapping.signal_counts(_scored(spark, d))


def set_equality(spark, d):
    """JOIN-09, SET-03, SET-04, CHK-09: occurrence and mapping ids of one side only."""
    return checks.set_differences(read_table(spark, d, "occurrences"), read_table(spark, d, "pp_mappings"), "datapoint_id")


def job_manifest(spark, d):
    """(chapter, form, status, row_count): a job for each chapter with German segments and form, as the extraction leaves it."""
    chapters = read_table(spark, d, "segments").filter(F.col("id").contains("_de_ch")).select("chapter").distinct()
    forms = F.explode(F.array(F.lit("contracted"), F.lit("uncontracted"))).alias("form")
    hits = read_table(spark, d, "occurrences").groupBy("chapter", "form").agg(F.count(F.lit(1)).alias("n"))
    rows = chapters.select("chapter", forms).join(hits, ["chapter", "form"], "left")
    return rows.select("chapter", "form", F.when(F.col("n") > 0, "ok").otherwise("zero_hits_ok").alias("status"), F.coalesce("n", F.lit(0)).alias("row_count"))


def manifest_gate(spark, d):
    """JOIN-26, CHK-14: chapters and forms of a full run that the job manifest lacks."""
    grid = spark.range(1, 18).select(F.col("id").cast("int").alias("chapter"), F.explode(F.array(F.lit("contracted"), F.lit("uncontracted"))).alias("form"))
    return checks.manifest_gaps(grid, job_manifest(spark, d), ["chapter", "form"])


def segment_faults(spark, d):
    """CHK-01, CHK-17: segments against their constraints."""
    return checks.segment_faults(read_table(spark, d, "segments"))


def alignment_faults(spark, d):
    """CHK-17: alignment records against their constraints."""
    return checks.alignment_faults(read_table(spark, d, "alignments")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def context_regression(spark, d):
    """CHK-12, JOIN-21, JOIN-27, SET-06, FN-43: mapped English ids that the context lacks."""
    cases = read_table(spark, d, "pp_mappings").groupBy("datapoint_id").agg(F.min(F.struct("loaded_at", "mapping_id", "en_sentence_ids")).alias("x"))
    where = read_table(spark, d, "occurrences").groupBy("datapoint_id").agg(F.min("source_segment_id").alias("segment_id"))
    cases = cases.join(where, "datapoint_id").select(F.col("datapoint_id").alias("key"), F.coalesce("x.en_sentence_ids", F.array().cast("array<string>")).alias("expected"), "segment_id")
    found = cases.select("key", "segment_id").join(side_context(spark, d), "segment_id").select("key", "context_ids", "provenance")
    return checks.context_regressions(cases.drop("segment_id"), found).select("key", F.array_join("missing", ",").alias("missing"))


def qc_issues(spark, d):
    """PRC-21, AGG-09, WIN-08, WIN-09: quality issues of segments."""
    rows = read_table(spark, d, "segments").distinct()
    return audit.quality_issues(rows).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def page_gaps(spark, d):
    """WIN-10: gaps in the source pages of chapters."""
    rows = read_table(spark, d, "segments").withColumn("scope", C.scope_of("id"))
    return audit.page_gaps(rows, ["scope"])


def id_impact(spark, d):
    """JOIN-22, JOIN-31, AGG-22: ids before and after the deletions of a date."""
    rows = read_table(spark, d, "segments").groupBy("id").agg(F.min(F.struct("loaded_at", "text", "deleted_at")).alias("x")).select("id", "x.*")
    old = rows.filter("loaded_at < timestamp '2023-07-01'")
    return audit.id_impact(old, rows.filter("deleted_at IS NULL")).groupBy("impact").agg(F.count(F.lit(1)).alias("n"))


def _orders(spark, d):
    return context.corpus_order(read_table(spark, d, "segments"))


def common_prefix(spark, d):
    """JOIN-25: common beginning of the German and English ordinals of chapters."""
    rows = _orders(spark, d).withColumn("id", F.substring("id", -10, 10))
    return audit.common_prefix(rows.filter("lang = 'de'"), rows.filter("lang = 'en'"), ["book", "chapter"])


def ordered_digest(spark, d):
    """AGG-19, MSC-09: digest of the ids of a chapter in order."""
    return audit.ordered_digests(_orders(spark, d), ["book", "lang", "chapter"])


def paragraph_at_offset(spark, d):
    """WIN-19: the paragraph at every 500th character of a chapter's stream."""
    rows = read_table(spark, d, "paragraphs").groupBy("book", "lang", "chapter", "paragraph").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    key = ["book", "lang", "chapter"]
    offsets = rows.groupBy(*key).agg(F.sum(F.length("text")).alias("n")).select(*key, F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(500))).alias("offset"))
    return audit.containing_paragraph(offsets, rows, key)


def source_statistics(spark, d):
    """AGG-27: blocks and paragraphs of chapters; the rest of AGG-27 is in source_counts."""
    count = lambda t, n: read_table(spark, d, t).groupBy("book", "lang", "chapter").agg(F.count(F.lit(1)).alias(n), F.sum(F.length("text")).alias(f"{n}_chars"))
    return count("ocr_blocks", "blocks").join(count("paragraphs", "paragraphs"), ["book", "lang", "chapter"], "full")


def stream_similarity(spark, d):
    """FN-17, FN-18, FN-39: how far Chinese segments differ from the next one of their chapter."""
    rows = _orders(spark, d).filter("lang = 'zh'")
    after = F.lead("text").over(W.partitionBy("book", "chapter").orderBy("pos"))
    pairs = rows.withColumn("next", after).filter("next IS NOT NULL").select("id", audit.stream_form("text").alias("a"), audit.stream_form("next").alias("b"))
    out = audit.similarity(pairs, "a", "b")
    return out.select("id", "ratio", C.verdict("ratio").alias("verdict"))


def source_counts(spark, d):
    """AGG-27: segments, notes and markers of chapters, each segment and block counted once."""
    blocks = clean.span_notes(_blocks(spark, d).withColumn("_markers", clean.marker_count(NOTE_SIZES[0])), *NOTE_SIZES)
    small = blocks.groupBy("book", "lang", "chapter").agg(F.sum(F.size("notes")).alias("notes"), F.sum("_markers").alias("markers"))
    segments = _orders(spark, d).groupBy("book", "lang", "chapter").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).alias("segments_chars"))
    return segments.join(small, ["book", "lang", "chapter"], "full").fillna(0, ["segments", "segments_chars", "notes", "markers"])


def chapter_regions(spark, d):
    """PRC-20, FLT-33: regions of the scanned blocks of a chapter that its cleaned paragraphs lack."""
    key, place = ["book", "lang", "chapter"], ["page", "block_idx", "block_id"]
    blocks = materialize(_blocks(spark, d).select(*key, *place, "text", "bbox", "confidence", "engine"), "region-blocks")  # read three times
    one_line = ~F.coalesce(C.strip("text").contains("\n"), F.lit(True))  # only such blocks can be titles
    rows = clean.classify_blocks(blocks).select(*key, *place, "norm", "bbox", "reason", F.when(one_line, F.col("text")).alias("text"))
    kept = materialize(rows, "region-classified").filter("reason IS NULL")  # filtered before it is written, norm would be made for each test
    lines = clean.mark_titles(kept.filter("text IS NOT NULL"), clean.running_titles(blocks)).filter("reason IS NULL")
    body = kept.filter("text IS NULL").unionByName(materialize(lines, "region-lines")).select(*key, *place, "norm", "bbox")  # read twice

    def stream(rows, order):
        parts = F.array_sort(F.collect_list(F.struct(*order, F.coalesce("text", F.lit("")).alias("text"))))
        return rows.groupBy(*key).agg(audit.stream_form(F.array_join(F.transform(parts, lambda x: x["text"]), "")).alias("stream"))

    raw = stream(spread(blocks.select(*key, *place, "text"), *key), place).withColumnRenamed("stream", "raw")
    old = stream(clean.assemble_paragraphs(body, OPENING), ["paragraph"]).withColumnRenamed("stream", "old")
    chapters = raw.join(old, key, "left").select(F.format_string("%s_%s_ch%02d", *key).alias("key"), "old", "raw", F.col("raw").alias("new"))
    return audit.chapter_regions(chapters).withColumns({c: F.round(c, 3) for c in ("ratio_old", "ratio_raw")})


NAMES = """cosine_pairs ratio_margin dp_align two_pass_align align_summary align_types align_sources_twice align_unknown_ids agreement legacy_normalize anchor_idf anchor_bonus side_context ordered_texts
candidate_rows candidate_summary unresolved_segments minimal_pairs canonical_prep form_distribution structural_gate dedup_identity identity_conflicts eligible_pool pool_funnel pilot_quota row_hash datapoint_ids
mapping_crosstab score_candidates signal_counts set_equality job_manifest manifest_gate segment_faults alignment_faults context_regression qc_issues page_gaps id_impact common_prefix ordered_digest paragraph_at_offset source_statistics stream_similarity source_counts chapter_regions""".split()
QUERIES = {n: globals()[n] for n in NAMES}

_LIST = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_PAIRS = """e AS (SELECT label || '_' || (vec_id // 500) AS scope, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT a.scope, CAST(a.vec_id AS VARCHAR) AS src_id, CAST(b.vec_id AS VARCHAR) AS tgt_id, list_dot_product(a.v, b.v) AS score FROM e a JOIN e b ON a.scope = b.scope AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"""
_CANON = lambda c: f"CASE {c} {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in X.CONTRACTIONS.items())} ELSE {c} END"
_ORDER = r"""firsts AS (SELECT id, min({'a': loaded_at, 'chapter': chapter, 'paragraph': paragraph, 'sentence': sentence, 'text': coalesce(text, '')}) AS x FROM segments GROUP BY id),
ordered AS (SELECT id, regexp_extract(id, '^(.+)_[a-z]+_ch\d+_', 1) AS book, regexp_extract(id, '^.+_([a-z]+)_ch\d+_', 1) AS lang, x.chapter AS chapter, x.text AS text,
  CAST(row_number() OVER (PARTITION BY regexp_extract(id, '^(.+)_[a-z]+_ch\d+_', 1), regexp_extract(id, '^.+_([a-z]+)_ch\d+_', 1), x.chapter ORDER BY x.paragraph, x.sentence, id) AS INT) AS pos FROM firsts)"""
_FIRST = lambda lang: f"""exploded_{lang} AS (SELECT unnest(list_filter(src, lambda x: x IS NOT NULL)) AS segment_id, loaded_at, align_id, src, list_filter(tgt, lambda x: x IS NOT NULL) AS tgt, confidence FROM alignments WHERE src_lang = 'de' AND tgt_lang = '{lang}'),
first_{lang} AS (SELECT segment_id, x.align_id AS align_id, x.src AS src, x.tgt AS tgt, x.confidence AS confidence FROM (SELECT segment_id, arg_min({{'align_id': align_id, 'src': src, 'tgt': tgt, 'confidence': confidence}}, (loaded_at, align_id, src, tgt, confidence)) AS x FROM exploded_{lang} GROUP BY segment_id))"""  # noqa: E731
_TEXTS = lambda lang: f"""texts_{lang} AS (SELECT segment_id, coalesce(string_agg(text, ' ' ORDER BY i) FILTER (length(text) > 0), '') AS t FROM (SELECT segment_id, unnest(tgt) AS id, generate_subscripts(tgt, 1) AS i FROM first_{lang}) LEFT JOIN ordered USING (id) GROUP BY segment_id)"""
_SUSPECT = "(len(regexp_extract_all(text, '[.!?…]+')) >= 2 OR len(string_split(text, '»')) - 1 >= 2 OR length(text) > 280)"
_CONTEXT = f"""{_ORDER}, {_FIRST('en')},
arrays AS (SELECT book, chapter, list(id ORDER BY pos) AS ids FROM ordered WHERE lang = 'en' GROUP BY ALL),
base AS (SELECT o.book, o.chapter, o.pos, o.id AS segment_id, o.text, f.src, f.tgt, f.confidence, coalesce(a.ids, []) AS ids FROM ordered o LEFT JOIN first_en f ON f.segment_id = o.id LEFT JOIN arrays a ON a.book = o.book AND a.chapter = o.chapter WHERE o.lang = 'de'),
near AS (SELECT *, last_value(CASE WHEN len(tgt) > 0 THEN tgt END IGNORE NULLS) OVER (PARTITION BY book, chapter ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(CASE WHEN len(tgt) > 0 THEN tgt END IGNORE NULLS) OVER (PARTITION BY book, chapter ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
  coalesce(len(src) >= 2, false) AS merge, {_SUSPECT} OR coalesce(confidence < 0.5, false) AS doubtful, coalesce(len(tgt), 0) > 0 AS anchored FROM base),
placed AS (SELECT *, list_filter(list_transform(coalesce(tgt, []), lambda a: list_position(ids, a)), lambda p: p IS NOT NULL AND p > 0) AS hits, CASE WHEN merge OR doubtful THEN 3 ELSE 1 END AS w,
  coalesce(list_position(ids, before[-1]), 0) AS lo0, coalesce(list_position(ids, after[1]), 0) AS hi0 FROM near),
ends AS (SELECT *, CASE WHEN lo0 > 0 THEN lo0 ELSE hi0 END AS lo, CASE WHEN hi0 > 0 THEN hi0 WHEN lo0 > 0 THEN lo0 ELSE 0 END AS hi FROM placed),
brackets AS (SELECT *, CASE WHEN lo > 0 AND hi >= lo AND hi - lo + 1 <= 6 THEN ids[lo:hi] ELSE [] END AS between_ids FROM ends),
side AS (SELECT segment_id, CASE WHEN anchored THEN CASE WHEN len(hits) > 0 THEN ids[greatest(list_min(hits) - w, 1):least(list_max(hits) + w, len(ids))] ELSE [] END ELSE between_ids END AS context_ids,
  CASE WHEN anchored THEN CASE WHEN merge THEN 'merge_widened' WHEN doubtful THEN 'heuristic_widened' ELSE 'anchor_window' END WHEN len(between_ids) > 0 THEN 'neighbor_fallback' ELSE 'manual_review' END AS provenance FROM brackets)"""
_NUMBER = r"regexp_extract_all(text, '\d+(?:[.,/]\d+)*')"
_ANCHORS = f"""{_ORDER}, s AS (SELECT printf('%s_ch%02d', book, chapter) AS scope, lang, id, text FROM ordered WHERE lang IN ('de', 'en')),
found AS (SELECT DISTINCT scope, lang, id, de_form AS anchor FROM s JOIN anchors ON contains(text, de_form) OR contains(text, en_form)
  UNION SELECT scope, lang, id, unnest(list_filter({_NUMBER}, lambda x: length(x) >= 2 OR contains(x, '/'))) FROM s),
sizes AS (SELECT scope, greatest(count(*), 2) AS n FROM s GROUP BY scope), dfs AS (SELECT scope, anchor, count(*) AS df FROM found GROUP BY ALL),
weights AS (SELECT scope, anchor, CASE WHEN df < n THEN least(1.0, ln(n / df) / ln(n)) ELSE 0.0 END AS weight FROM dfs JOIN sizes USING (scope))"""
_LEMMA = "coalesce(nullif(corrected_head_lemma, ''), machine_head_lemma, '')"
_IDENTITY = "chapter, source_segment_id, parse_block_id, pp_token_start, pp_token_end"
_CORE = "coalesce(form, ''), coalesce(canonical_prep, ''), coalesce(machine_head_lemma, ''), coalesce(decision, ''), coalesce(corrected_head_lemma, '')"
_DEDUP = f"deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_IDENTITY} ORDER BY loaded_at, datapoint_id, {_CORE}) AS rn FROM occurrences) WHERE rn = 1)"
_GATE = "CASE WHEN form = 'contracted' THEN true WHEN det_xpos IS NULL OR det_deprel IS NULL THEN NULL ELSE det_xpos = 'ART' AND det_deprel = 'det' END"
_POOL = f"""{_DEDUP}, prepared AS (SELECT *, {_CANON('canonical_prep')} AS prep, {_LEMMA} AS head_lemma, {_GATE} AS gate FROM deduped),
pairs AS (SELECT DISTINCT prep, head_lemma FROM prepared WHERE prep IN ({_LIST(X.SHARED_PREPOSITIONS)}) AND form = 'uncontracted' AND decision = 'include' AND gate),
pool AS (SELECT p.*, CASE WHEN coalesce(p.prep NOT IN ({_LIST(X.SHARED_PREPOSITIONS)}), true) THEN 'outside_inventory' WHEN gate IS NULL THEN 'missing_structure' WHEN NOT gate THEN 'not_article' WHEN decision = 'exclude' THEN 'excluded'
  WHEN coalesce(decision <> 'include', true) THEN 'undecided' WHEN form = 'uncontracted' THEN 'uncontracted_included' WHEN chapter IN (1, 2, 3) THEN 'contracted_reviewed' WHEN q.prep IS NOT NULL THEN 'contracted_paired' ELSE 'contracted_unpaired' END AS pool_reason
  FROM prepared p LEFT JOIN pairs q ON q.prep = p.prep AND q.head_lemma = p.head_lemma),
judged AS (SELECT *, pool_reason IN ('uncontracted_included', 'contracted_reviewed', 'contracted_paired') AS eligible FROM pool)"""
_KEY = "chapter, source_segment_id NULLS FIRST, parse_block_id, pp_token_start, pp_token_end, datapoint_id"
_GROUPS = f"(SELECT canonical_prep || '|' || {_LEMMA} AS pair, count(*) FILTER (form = 'contracted') AS contracted, count(*) FILTER (form = 'uncontracted') AS uncontracted FROM %s GROUP BY ALL HAVING contracted > 0 AND uncontracted > 0)"
_CAND = f"""{_ORDER}, {_FIRST('en')}, {_FIRST('zh')}, {_TEXTS('en')}, {_TEXTS('zh')},
o AS (SELECT DISTINCT datapoint_id, chapter, form, canonical_prep, machine_head_lemma, source_segment_id FROM occurrences),
cand AS (SELECT o.*, s.text AS de_text, e.tgt AS en_ids, coalesce(te.t, '') AS en_text, CASE WHEN e.segment_id IS NOT NULL THEN len(e.src) || ':' || coalesce(len(e.tgt), 0) END AS en_cardinality, e.confidence AS en_confidence, CASE WHEN e.segment_id IS NULL THEN 'missing' ELSE 'aligned' END AS en_status,
  z.tgt AS zh_ids, coalesce(tz.t, '') AS zh_text, CASE WHEN z.segment_id IS NOT NULL THEN len(z.src) || ':' || coalesce(len(z.tgt), 0) END AS zh_cardinality, z.confidence AS zh_confidence, CASE WHEN z.segment_id IS NULL THEN 'missing' ELSE 'aligned' END AS zh_status,
  {_CANON('canonical_prep')} || '|' || coalesce(machine_head_lemma, '') AS pair
  FROM o JOIN ordered s ON s.id = o.source_segment_id LEFT JOIN first_en e ON e.segment_id = o.source_segment_id LEFT JOIN texts_en te ON te.segment_id = o.source_segment_id LEFT JOIN first_zh z ON z.segment_id = o.source_segment_id LEFT JOIN texts_zh tz ON tz.segment_id = o.source_segment_id)"""
_RULES_SEG = {"bad_id": f"id IS NULL OR NOT regexp_matches(id, '{X.SEGMENT_ID}')", "bad_ordinal": "chapter < 1 OR paragraph < 1 OR sentence < 1", "no_text": "length(trim(coalesce(text, ''))) = 0", "no_pages": "coalesce(len(source_pages), 0) = 0"}
_RULES_AL = {
    "bad_id": "NOT regexp_full_match(align_id, 'a\\d+')", "bad_confidence": "confidence IS NULL OR NOT confidence BETWEEN 0 AND 1", "bad_margin": "margin < 0", "blank_language": "trim(coalesce(src_lang, '')) = '' OR trim(coalesce(tgt_lang, '')) = ''",
    "null_element": "len(list_filter(src, lambda x: x IS NULL)) > 0 OR len(list_filter(tgt, lambda x: x IS NULL)) > 0", "type_mismatch": "type <> coalesce(len(src), 0) || ':' || coalesce(len(tgt), 0)",
}

_ALL_FORMS = sorted({w for v in X.PREP_FORMS["en"].values() for w in v})
_CAPS = lambda x: f"list_distinct(list_transform(list_filter(string_split_regex({x}, '\\s+'), lambda w: regexp_matches(w, '^\\p{{Lu}}')), lambda w: lower(w)))"
_SCORED = f"""WITH {_ORDER}, m AS (SELECT datapoint_id, arg_min({{'ids': en_sentence_ids, 'c': en_alignment_confidence}}, (loaded_at, mapping_id, en_sentence_ids, en_alignment_confidence)) AS x FROM pp_mappings GROUP BY 1),
o AS (SELECT datapoint_id, x.p AS canonical_prep, coalesce(nullif(x.c, ''), x.m, '') AS de_lemma FROM (SELECT datapoint_id, min({{'l': loaded_at, 'p': canonical_prep, 'c': corrected_head_lemma, 'm': machine_head_lemma}}) AS x FROM occurrences GROUP BY 1)),
n AS (SELECT datapoint_id, x.c AS confidence, unnest(x.ids) AS id, generate_subscripts(x.ids, 1) - 1 AS pos FROM m),
w AS (SELECT datapoint_id, confidence, n.pos, regexp_extract_all(text, '[A-Za-z-]+') AS ws FROM n JOIN ordered USING (id)),
e AS (SELECT datapoint_id, confidence, pos, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, ws FROM w),
h AS (SELECT *, lower(ws[i + 1]) IN ('the', 'a', 'an') AS article, CASE WHEN lower(ws[i + 1]) IN ('the', 'a', 'an') THEN ws[i + 2] ELSE ws[i + 1] END AS head FROM e WHERE lower(w) IN ({", ".join(f"'{x}'" for x in _ALL_FORMS)})),
p AS (SELECT *, CAST(pos * 1000 + row_number() OVER (PARTITION BY datapoint_id, pos ORDER BY i) - 1 AS INT) AS cand, w || CASE WHEN article THEN ' ' || ws[i + 1] ELSE '' END || ' ' || head AS span FROM h WHERE head IS NOT NULL),
j AS (SELECT p.*, {_CANON("canonical_prep")} AS de_prep, de_lemma FROM p JOIN o USING (datapoint_id)),
f AS (SELECT *, coalesce(list_contains(CASE de_prep {" ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in X.PREP_FORMS["en"].items())} ELSE [] END, lower(w)), false) AS s1,
  list_has_any({_CAPS("de_lemma")}, list_concat({_CAPS("span")}, CASE WHEN regexp_matches(head, '^[A-Z]') THEN [lower(head)] ELSE [] END)) AS s2,
  trim(de_lemma) <> '' AND (contains(lower(trim(de_lemma)), lower(head)) OR contains(lower(head), lower(trim(de_lemma)))) AS s3, coalesce(confidence > {X.CONFIDENCE_BONUS["en"]}, false) AS s5 FROM j),
scored AS (SELECT *, CAST(s1 AS INT) * 3.0::DOUBLE + CAST(s2 AS INT) * 5.0::DOUBLE + CAST(s3 AS INT) * 2.0::DOUBLE + 2.0::DOUBLE + CAST(s5 AS INT) * 1.0::DOUBLE AS score FROM f)"""

#: Notes of blocks as the SQL of span_notes finds them, with their chapter and the number of markers.
_NOTED = cleaning.ORACLE["span_notes"].split("\nSELECT block_id")[0].removeprefix("WITH ").replace("SELECT block_id, text, lines,", "SELECT block_id, book, lang, chapter, text, lines,")

ORACLE = {
    "cosine_pairs": f"WITH {_PAIRS} SELECT scope, src_id, tgt_id, round(score, {PRECISION}) AS score FROM pairs",
    "ratio_margin": f"""WITH {_PAIRS}, f AS (SELECT scope, src_id, avg(score) AS m FROM (SELECT *, row_number() OVER (PARTITION BY scope, src_id ORDER BY score DESC, tgt_id) AS r FROM pairs) WHERE r <= 4 GROUP BY ALL),
b AS (SELECT scope, tgt_id, avg(score) AS m FROM (SELECT *, row_number() OVER (PARTITION BY scope, tgt_id ORDER BY score DESC, src_id) AS r FROM pairs) WHERE r <= 4 GROUP BY ALL),
q AS (SELECT scope, src_id, tgt_id, score / greatest((f.m + b.m) / 2, 1e-9) AS q FROM pairs JOIN f USING (scope, src_id) JOIN b USING (scope, tgt_id)) SELECT scope, src_id, tgt_id, round(q / (1 + q), 4) AS ratio FROM q""",
    "align_summary": f"""SELECT src_lang, tgt_lang, count(*) AS records, round(avg(confidence), {PRECISION}) AS mean_confidence, round(quantile_cont(confidence, 0.5), {PRECISION}) AS median_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence,
count(*) FILTER (confidence < 0.5) AS below_half, round(avg(margin), {PRECISION}) AS mean_margin, count(*) FILTER (margin < 0.02) AS thin_margin, count(*) FILTER (needs_review) AS needs_review FROM alignments GROUP BY ALL""",
    "align_types": "SELECT type, method, count(*) AS n FROM alignments GROUP BY ALL",
    "align_sources_twice": "WITH r AS (SELECT src_lang, tgt_lang, align_id, unnest(src) AS segment_id FROM alignments) SELECT src_lang, tgt_lang, segment_id, count(DISTINCT align_id) AS records FROM r WHERE segment_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT align_id) > 1",
    "align_unknown_ids": "WITH i AS (SELECT 'src' AS side, unnest(src) AS id FROM alignments UNION SELECT 'tgt', unnest(tgt) FROM alignments) SELECT id, side FROM i WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM segments)",
    "legacy_normalize": r"""WITH r AS (SELECT DISTINCT align_id, src, tgt, confidence FROM alignments WHERE tgt_lang = 'zh')
SELECT align_id, coalesce(array_to_string(src, ','), '') AS src, coalesce(array_to_string(tgt, ','), '') AS tgt, nullif(regexp_extract(coalesce(src[1], ''), '^[a-z0-9]+_([a-z]{2,3})_ch', 1), '') AS src_lang, nullif(regexp_extract(coalesce(tgt[1], ''), '^[a-z0-9]+_([a-z]{2,3})_ch', 1), '') AS tgt_lang, 'embedding_dp' AS method, confidence FROM r""",
    "anchor_idf": f"WITH {_ANCHORS} SELECT scope, anchor, round(weight, {PRECISION}) AS weight FROM weights",
    "anchor_bonus": f"""WITH {_ANCHORS} SELECT a.scope, a.id AS src_id, b.id AS tgt_id, round(least(0.15, 0.05 * sum(weight)), 5) AS bonus FROM found a JOIN found b ON a.scope = b.scope AND a.anchor = b.anchor AND a.lang = 'de' AND b.lang = 'en' JOIN weights w ON w.scope = a.scope AND w.anchor = a.anchor GROUP BY ALL""",
    "side_context": f"WITH {_CONTEXT} SELECT * FROM side",
    "ordered_texts": f"WITH {_ORDER}, {_FIRST('en')} SELECT f.segment_id, coalesce(t, '') AS en_text FROM first_en f LEFT JOIN (SELECT segment_id, string_agg(text, ' ' ORDER BY i) FILTER (length(text) > 0) AS t FROM (SELECT segment_id, unnest(tgt) AS id, generate_subscripts(tgt, 1) AS i FROM first_en) LEFT JOIN ordered USING (id) GROUP BY segment_id) USING (segment_id)",
    "candidate_rows": f"WITH {_CAND} SELECT * FROM cand",
    "candidate_summary": f"""WITH {_CAND} SELECT form, chapter, count(*) AS rows, count(*) FILTER (en_status = 'missing') AS en_missing, count(*) FILTER (zh_status = 'missing') AS zh_missing, count(*) FILTER (regexp_full_match(en_cardinality, '1:[2-9]')) AS en_one_to_many, count(*) FILTER (regexp_full_match(en_cardinality, '[2-9]:1')) AS en_many_to_one, count(DISTINCT pair) AS pairs FROM cand GROUP BY ALL""",
    "unresolved_segments": "SELECT source_segment_id, count(*) AS rows FROM occurrences WHERE source_segment_id IS NOT NULL AND source_segment_id NOT IN (SELECT id FROM segments) GROUP BY ALL",
    "minimal_pairs": f"SELECT * FROM {_GROUPS % 'occurrences'}",
    "canonical_prep": f"WITH p AS (SELECT {_CANON('canonical_prep')} AS prep FROM occurrences) SELECT prep, coalesce(prep IN ({_LIST(X.SHARED_PREPOSITIONS)}), false) AS shared, count(*) AS n FROM p GROUP BY ALL",
    "form_distribution": "SELECT form, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM occurrences GROUP BY form",
    "structural_gate": f"SELECT form, coalesce(CAST({_GATE} AS VARCHAR), 'unknown') AS gate, count(*) AS n FROM occurrences GROUP BY ALL",
    "dedup_identity": f"WITH {_DEDUP} SELECT datapoint_id, form, decision, loaded_at FROM deduped",
    "identity_conflicts": f"SELECT {_IDENTITY}, count(*) AS rows, count(DISTINCT ({_CORE})) AS variants FROM occurrences GROUP BY {_IDENTITY} HAVING count(DISTINCT ({_CORE})) > 1",
    "eligible_pool": f"WITH {_POOL} SELECT datapoint_id, head_lemma, pool_reason, eligible FROM judged",
    "pool_funnel": f"WITH {_POOL} SELECT pool_reason, form, count(*) AS n, count(*) FILTER (eligible) AS eligible FROM judged GROUP BY ALL",
    "pilot_quota": f"""WITH {_DEDUP}, g AS {_GROUPS % 'deduped'}, t AS (SELECT d.*, CASE WHEN g.pair IS NOT NULL AND row_number() OVER (PARTITION BY d.canonical_prep || '|' || {_LEMMA}, form ORDER BY {_KEY}) = 1 THEN 'minimal_pair' WHEN inventory_eligible THEN 'author_match' ELSE 'stable_fill' END AS tier
  FROM deduped d LEFT JOIN g ON g.pair = d.canonical_prep || '|' || {_LEMMA}),
r AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY CASE tier WHEN 'minimal_pair' THEN 1 WHEN 'author_match' THEN 2 ELSE 3 END, {_KEY}) AS r FROM t) SELECT datapoint_id, form, tier FROM r WHERE r <= 40""",
    "row_hash": "SELECT datapoint_id, sha256(" + " || chr(31) || ".join(f"'{c}=' || coalesce(CAST({c} AS VARCHAR), '')" for c in HASHED) + ") AS hash FROM (SELECT DISTINCT " + ", ".join(HASHED) + " FROM occurrences)",
    "datapoint_ids": "SELECT printf('dp_ch%02d_%s_t%d-%d', chapter, parse_block_id, pp_token_start, pp_token_end) = datapoint_id AS same, count(*) AS n FROM (SELECT DISTINCT * FROM occurrences) GROUP BY ALL",
    "mapping_crosstab": """WITH s AS (SELECT chapter, CASE WHEN coalesce(len(en_sentence_ids), 0) > 0 THEN 'found' ELSE 'none' END AS en, CASE WHEN coalesce(len(zh_sentence_ids), 0) > 0 THEN 'found' ELSE 'none' END AS zh FROM pp_mappings)
SELECT chapter, en, zh, count(*) AS n FROM s GROUP BY GROUPING SETS ((chapter, en, zh), (en, zh))""",
    "score_candidates": f"""{_SCORED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY datapoint_id ORDER BY score DESC, cand) AS INT) AS rank FROM scored)
SELECT datapoint_id, cand, score, rank, CASE WHEN score >= {X.MATCHED} THEN 'matched' WHEN score >= {X.CANDIDATE} THEN 'candidate' ELSE 'unmappable' END AS status FROM r WHERE rank <= 4""",
    "signal_counts": f"""{_SCORED}, s AS (SELECT unnest(['prep_semantic_match', 'proper_name_overlap', 'lemma_overlap', 'position_match', 'align_confidence_bonus']) AS signal, unnest([s1, s2, s3, true, s5]) AS fired FROM scored)
SELECT signal, count(*) AS n FROM s WHERE fired GROUP BY signal""",
    "set_equality": "SELECT DISTINCT datapoint_id, 'left' AS side FROM occurrences WHERE datapoint_id NOT IN (SELECT datapoint_id FROM pp_mappings WHERE datapoint_id IS NOT NULL) UNION ALL SELECT DISTINCT datapoint_id, 'right' FROM pp_mappings WHERE datapoint_id NOT IN (SELECT datapoint_id FROM occurrences WHERE datapoint_id IS NOT NULL)",
    "job_manifest": """WITH c AS (SELECT DISTINCT chapter FROM segments WHERE contains(id, '_de_ch')), g AS (SELECT chapter, f AS form FROM c, (VALUES ('contracted'), ('uncontracted')) u(f)), h AS (SELECT chapter, form, count(*) AS n FROM occurrences GROUP BY ALL)
SELECT chapter, form, CASE WHEN n > 0 THEN 'ok' ELSE 'zero_hits_ok' END AS status, coalesce(n, 0) AS row_count FROM g LEFT JOIN h USING (chapter, form)""",
    "manifest_gate": "WITH g AS (SELECT CAST(c AS INT) AS chapter, f AS form FROM range(1, 18) t(c), (VALUES ('contracted'), ('uncontracted')) u(f)) SELECT chapter, form, 'missing' AS status FROM g ANTI JOIN (SELECT DISTINCT chapter FROM segments WHERE contains(id, '_de_ch')) o USING (chapter)",
    "agreement": r"""WITH r AS (SELECT *, nullif(regexp_extract(src[1], '^([a-z0-9]+_[a-z]+_ch\d{2})_', 1), '') AS scope, '{"src":[' || array_to_string(list_transform(src, lambda x: coalesce('"' || x || '"', 'null')), ',') || '],"tgt":[' || array_to_string(list_transform(coalesce(tgt, []), lambda x: coalesce('"' || x || '"', 'null')), ',') || ']}' AS j FROM alignments WHERE src_lang = 'de' AND len(src) > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY scope, tgt_lang ORDER BY align_id NULLS FIRST, loaded_at NULLS FIRST, j, confidence NULLS FIRST) AS pos FROM r WHERE scope IS NOT NULL)
SELECT scope, count(*) AS compared, round(avg(CAST(a.confidence = b.confidence AS INT)), 6) AS agree_rate FROM p a JOIN p b USING (scope, pos) WHERE a.tgt_lang = 'en' AND b.tgt_lang = 'zh' GROUP BY scope""",
    "segment_faults": " UNION ALL ".join(f"SELECT '{r}' AS rule, id AS key FROM segments WHERE {c}" for r, c in _RULES_SEG.items()),
    "alignment_faults": "SELECT rule, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule FROM alignments WHERE {c}" for r, c in _RULES_AL.items()) + ") GROUP BY rule",
    "context_regression": f"""WITH {_CONTEXT}, cases AS (SELECT datapoint_id, arg_min(coalesce(en_sentence_ids, []), (loaded_at, mapping_id, en_sentence_ids)) AS expected FROM pp_mappings GROUP BY datapoint_id), o AS (SELECT datapoint_id, min(source_segment_id) AS segment_id FROM occurrences GROUP BY datapoint_id),
m AS (SELECT c.datapoint_id AS key, list_filter(expected, lambda x: NOT list_contains(coalesce(context_ids, []), x)) AS missing, provenance FROM cases c JOIN o USING (datapoint_id) LEFT JOIN side USING (segment_id))
SELECT key, array_to_string(list_filter(missing, lambda x: x IS NOT NULL), ',') AS missing FROM m WHERE len(missing) > 0 AND coalesce(provenance, '') <> 'manual_review'""",
    "qc_issues": f"""WITH r AS (SELECT DISTINCT * FROM segments), x AS (SELECT *, coalesce(regexp_matches(id, '{X.SEGMENT_ID}'), false) AS ok, try_cast(regexp_extract(id, '_p(\\d{{4}})_', 1) AS INT) * 1000 + try_cast(regexp_extract(id, '_s(\\d{{3}})$', 1) AS INT) AS place,
  try_cast(regexp_extract(id, '_ch(\\d{{2}})_', 1) AS INT) AS ch, regexp_extract(id, '^(.+?)_ch', 1) AS b, length(regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g')) AS n, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS k FROM r),
y AS (SELECT *, lag(CASE WHEN ok THEN place END) OVER (PARTITION BY b, chapter ORDER BY loaded_at, id) AS q FROM x),
i AS (SELECT unnest([CASE WHEN k > 1 THEN 'duplicate_id' END, CASE WHEN n = 0 THEN 'empty_text' END, CASE WHEN n > 0 AND n < 3 THEN 'short_fragment' END, CASE WHEN length(text) > 1000 THEN 'abnormally_long' END, CASE WHEN NOT ok THEN 'malformed_id' END,
  CASE WHEN ok AND ch <> chapter THEN 'mixed_chapter' END, CASE WHEN ok AND place < q THEN 'non_monotonic_id' END]) AS issue FROM y) SELECT issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY issue""",
    "source_counts": f"""WITH {_ORDER}, {_NOTED}, s AS (SELECT book, lang, chapter, count(*) AS segments, sum(length(text)) AS chars FROM ordered GROUP BY ALL),
m AS (SELECT book, lang, chapter, sum(len(list_filter(ts, lambda x: x.note AND x.text <> ''))) AS notes, sum(coalesce(list_sum(list_transform(ls, lambda x: x.n - len(x.rest))), 0)) AS markers FROM told GROUP BY ALL)
SELECT coalesce(s.book, m.book) AS book, coalesce(s.lang, m.lang) AS lang, coalesce(s.chapter, m.chapter) AS chapter, coalesce(segments, 0) AS segments, coalesce(chars, 0) AS segments_chars, coalesce(notes, 0) AS notes, coalesce(markers, 0) AS markers
FROM s FULL JOIN m ON s.book = m.book AND s.lang = m.lang AND s.chapter = m.chapter""",
    "page_gaps": r"""WITH p AS (SELECT DISTINCT nullif(regexp_extract(id, '^([a-z0-9]+_[a-z]+_ch\d{2})_', 1), '') AS scope, unnest(source_pages) AS page FROM segments), l AS (SELECT scope, page AS "before", lead(page) OVER (PARTITION BY scope ORDER BY page) AS "after" FROM p) SELECT * FROM l WHERE "after" - "before" > 1""",
    "id_impact": """WITH f AS (SELECT id, arg_min({'l': loaded_at, 't': coalesce(text, ''), 'd': deleted_at}, (loaded_at, text, deleted_at)) AS x FROM (SELECT DISTINCT id, loaded_at, text, deleted_at FROM segments) GROUP BY id), o AS (SELECT id, x.t AS a FROM f WHERE x.l < '2023-07-01'), n AS (SELECT id, x.t AS b FROM f WHERE x.d IS NULL)
SELECT CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a = b THEN 'kept' ELSE 'changed' END AS impact, count(*) AS n FROM o FULL JOIN n USING (id) GROUP BY ALL""",
    "common_prefix": f"""WITH {_ORDER}, a AS (SELECT book, chapter, pos, right(id, 10) AS x FROM ordered WHERE lang = 'de'), b AS (SELECT book, chapter, pos, right(id, 10) AS y FROM ordered WHERE lang = 'en'),
j AS (SELECT * FROM a FULL JOIN b USING (book, chapter, pos)) SELECT book, chapter, CAST(coalesce(min(pos) FILTER (x IS DISTINCT FROM y) - 1, count(*)) AS INT) AS prefix FROM j GROUP BY ALL""",
    "ordered_digest": f"WITH {_ORDER} SELECT book, lang, chapter, sha256(string_agg(id || chr(31), '' ORDER BY pos)) AS digest FROM ordered GROUP BY ALL",
    "paragraph_at_offset": """WITH p AS (SELECT book, lang, chapter, paragraph, coalesce(min(text), '') AS text FROM paragraphs GROUP BY ALL), s AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY book, lang, chapter ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
o AS (SELECT book, lang, chapter, unnest(range(0, greatest(CAST(sum(length(text)) AS BIGINT) - 1, 0) + 1, 500)) AS "offset" FROM p GROUP BY book, lang, chapter)
SELECT o.book, o.lang, o.chapter, o."offset", max(s.paragraph) AS paragraph FROM o JOIN s ON s.book = o.book AND s.lang = o.lang AND s.chapter = o.chapter AND s.start <= o."offset" GROUP BY ALL""",
    "source_statistics": """WITH b AS (SELECT book, lang, chapter, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS blocks_chars FROM ocr_blocks GROUP BY ALL), p AS (SELECT book, lang, chapter, count(*) AS paragraphs, CAST(sum(length(text)) AS BIGINT) AS paragraphs_chars FROM paragraphs GROUP BY ALL) SELECT * FROM b FULL JOIN p USING (book, lang, chapter)""",
}
