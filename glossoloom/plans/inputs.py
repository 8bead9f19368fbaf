"""Queries over what stands before a run, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as X
from ..operators import audit, eligibility, inputs
from ..session import read_table
from . import corpus

PAIRS = [("de", "en"), ("de", "zh")]


def alignment_sides(spark, d):
    """SRC-16, SRC-17: the language of each side of the alignment records, by ids or by elimination, and their faults."""
    langs = F.array_distinct(F.filter(F.array("src_lang", "tgt_lang"), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    rows = inputs.side_languages(read_table(spark, d, "alignments"), langs)
    return rows.groupBy("src_side", "tgt_side", "fault").agg(F.count(F.lit(1)).alias("n"))


def alignment_blocks(spark, d):
    """JOIN-12: parse blocks of the source segments of alignment records in order, and segments without any."""
    blocks = read_table(spark, d, "occurrences").select(F.col("source_segment_id").alias("segment_id"), C.block_parts("parse_block_id")["ordinal"].alias("ord"), F.col("parse_block_id").alias("sent_id"))
    rows = inputs.blocks_in_order(read_table(spark, d, "alignments"), blocks.filter("sent_id IS NOT NULL"))
    return rows.select("align_id", "pos", "segment_id", F.array_join("sent_ids", ",").alias("sent_ids"))


def filter_flags(spark, d):
    """JOIN-18, SRC-32: hits whose preposition and lemma an included uncontracted hit has, counted."""
    rows = read_table(spark, d, "occurrences").select("form", "decision", C.canonical_prep("canonical_prep").alias("prep"), eligibility.head_lemma().alias("noun"))
    listed = rows.filter("form = 'uncontracted' AND decision = 'include'")
    return inputs.flagged(rows, listed, ["prep", "noun"], "in_filter").groupBy("form", "in_filter").agg(F.count(F.lit(1)).alias("n"))


def matched_keys(spark, d):
    """JOIN-19, FLT-23: hits whose five-part key a mapped occurrence has, counted by form and author match."""
    rows = read_table(spark, d, "occurrences")
    mapped = rows.join(read_table(spark, d, "pp_mappings").select("datapoint_id").distinct(), "datapoint_id", "left_semi")
    out = inputs.flagged(rows, mapped, eligibility.IDENTITY, "matched")
    return out.groupBy("form", F.coalesce("inventory_eligible", F.lit(False)).alias("author_match"), "matched").agg(F.count(F.lit(1)).alias("n"))


def id_collisions(spark, d):
    """SET-08: segment and datapoint ids that stand in several chapters."""
    seg = inputs.shared_ids(read_table(spark, d, "segments"), "id", F.col("chapter"))
    occ = inputs.shared_ids(read_table(spark, d, "occurrences").withColumnRenamed("datapoint_id", "id"), "id", F.col("chapter"))
    return seg.select(F.lit("segments").alias("kind"), "id", "scopes").unionByName(occ.select(F.lit("occurrences").alias("kind"), "id", "scopes"))


def artifact_references(spark, d):
    """SRC-37: segment ids that delivered annotation files mention, and those that no segment has."""
    return inputs.artifact_references(read_table(spark, d, "annotation_pairs").distinct(), read_table(spark, d, "segments"))


def run_configs(spark, d):
    """SRC-40, PRJ-17: a configuration for every chapter and pair of languages."""
    parts = C.segment_parts("id")
    scopes = read_table(spark, d, "segments").select(parts["book"].alias("book"), parts["chapter"].alias("chapter")).filter("book IS NOT NULL")
    return inputs.run_configs(scopes, PAIRS)


def cache_outcomes(spark, d):
    """SRC-29, JOIN-30, SNK-13: which chapters' vectors of the deliveries until June 2023 serve the chapters of today."""
    rows = read_table(spark, d, "segments").withColumn("scope", C.scope_of("id")).filter("scope IS NOT NULL")
    first = lambda df: df.groupBy("scope", "id").agg(F.min(F.struct("loaded_at", F.coalesce("text", F.lit("")).alias("text"))).alias("x")).select("scope", "id", "x.text")
    out = inputs.cache_outcomes(first(rows.filter("deleted_at IS NULL")), first(rows.filter("loaded_at < timestamp '2023-07-01'")), ["scope"])
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def alignment_manifest(spark, d):
    """SNK-16, PRJ-16, AGG-25: manifest entries of the alignment of each chapter and pair."""
    return inputs.alignment_manifest(read_table(spark, d, "alignments")).withColumn("mean_confidence", F.round("mean_confidence", 6))


def qc_examples(spark, d):
    """SRT-09: the first three segments of each quality issue."""
    return inputs.first_examples(audit.quality_issues(read_table(spark, d, "segments").distinct()), "issue", "id", 3)


def text_keys(spark, d):
    """FN-19, FN-21, FN-41, FN-48: names as path parts, numbers from text, and sorted distinct lists."""
    rows = read_table(spark, d, "documents").select(inputs.slug(F.coalesce("source", F.lit(""))).alias("slug"), inputs.int_or_minus(F.regexp_extract(F.coalesce("text", F.lit("")), r"([0-9]{1,4})", 1)).alias("number"), "lang")
    known = F.array_sort(F.array_distinct(F.collect_set("lang")))
    return rows.groupBy("slug").agg(F.concat(F.lit("query: "), F.array_join(known, ",")).alias("langs"), F.sum("number").alias("numbers"))


NAMES = "alignment_sides alignment_blocks filter_flags matched_keys id_collisions artifact_references run_configs cache_outcomes alignment_manifest qc_examples text_keys".split()
QUERIES = {n: globals()[n] for n in NAMES}

_ID = r"^[a-z0-9]+_([a-z]+)_ch\d{2}_p\d{4}_s\d{3}$"
_LANGS = lambda c: f"list_distinct(list_transform(coalesce({c}, []), lambda x: coalesce(nullif(regexp_extract(x, '{_ID}', 1), ''), '?')))"
_PREP = "CASE canonical_prep " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.CONTRACTIONS.items()) + " ELSE canonical_prep END"
_LEMMA = "coalesce(nullif(corrected_head_lemma, ''), machine_head_lemma, '')"
#: The issues of segments with their ids, as the SQL of their counts has them.
_ISSUES = corpus.ORACLE["qc_issues"].split(") SELECT issue, count(*)")[0].replace("i AS (SELECT unnest(", "i AS (SELECT id, unnest(") + ")"
_FIVE = ", ".join(eligibility.IDENTITY)

ORACLE = {
    "alignment_sides": f"""WITH l AS (SELECT *, list_distinct(list_filter([src_lang, tgt_lang], lambda x: trim(coalesce(x, '')) <> '')) AS expected, {_LANGS('src')} AS a, {_LANGS('tgt')} AS b, coalesce(src, []) AS s, coalesce(tgt, []) AS t FROM alignments),
f AS (SELECT *, s = t AND len(s) > 0 AS same, list_filter(expected, lambda x: NOT list_contains(a, x) AND NOT list_contains(b, x)) AS rest,
  CASE WHEN list_contains(a, '?') OR list_contains(b, '?') THEN 'unparseable' WHEN len(a) > 1 OR len(b) > 1 THEN 'mixed'
    WHEN len(expected) > 0 AND len(list_filter(list_concat(a, b), lambda x: NOT list_contains(expected, x))) > 0 THEN 'unexpected' WHEN NOT (s = t AND len(s) > 0) AND list_has_any(s, t) THEN 'repeated' END AS fault FROM l)
SELECT CASE WHEN fault IS NULL THEN CASE WHEN len(a) = 1 THEN a[1] WHEN len(a) = 0 AND len(rest) = 1 THEN rest[1] END END AS src_side,
  CASE WHEN fault IS NULL AND NOT same THEN CASE WHEN len(b) = 1 THEN b[1] WHEN len(b) = 0 AND len(rest) = 1 THEN rest[1] END END AS tgt_side, fault, count(*) AS n FROM f GROUP BY ALL""",
    "alignment_blocks": r"""WITH b AS (SELECT DISTINCT source_segment_id AS segment_id, parse_block_id AS sent_id, CASE WHEN try_cast(regexp_extract(parse_block_id, '#b(\d{3,})$', 1) AS INT) >= 1 THEN try_cast(regexp_extract(parse_block_id, '#b(\d{3,})$', 1) AS INT) END AS ord FROM occurrences WHERE source_segment_id IS NOT NULL AND parse_block_id IS NOT NULL),
i AS (SELECT segment_id, string_agg(sent_id, ',' ORDER BY ord NULLS FIRST, sent_id) AS sent_ids FROM b GROUP BY 1),
n AS (SELECT align_id, unnest(src) AS segment_id, CAST(generate_subscripts(src, 1) - 1 AS INT) AS pos FROM (SELECT DISTINCT align_id, src FROM alignments))
SELECT align_id, pos, n.segment_id, coalesce(sent_ids, '') AS sent_ids FROM n LEFT JOIN i ON i.segment_id = n.segment_id""",
    "filter_flags": f"""WITH r AS (SELECT form, decision, {_PREP} AS prep, {_LEMMA} AS noun FROM occurrences), l AS (SELECT DISTINCT prep, noun FROM r WHERE form = 'uncontracted' AND decision = 'include' AND prep IS NOT NULL)
SELECT form, CASE WHEN l.prep IS NOT NULL THEN 'Y' ELSE 'N' END AS in_filter, count(*) AS n FROM r LEFT JOIN l USING (prep, noun) GROUP BY ALL""",
    "matched_keys": f"""WITH m AS (SELECT DISTINCT {_FIVE}, true AS hit FROM occurrences WHERE datapoint_id IN (SELECT datapoint_id FROM pp_mappings WHERE datapoint_id IS NOT NULL))
SELECT form, coalesce(inventory_eligible, false) AS author_match, CASE WHEN hit THEN 'Y' ELSE 'N' END AS matched, count(*) AS n FROM occurrences LEFT JOIN m USING ({_FIVE}) GROUP BY ALL""",
    "id_collisions": """SELECT 'segments' AS kind, id, count(DISTINCT chapter) AS scopes FROM segments GROUP BY id HAVING count(DISTINCT chapter) > 1
UNION ALL SELECT 'occurrences', datapoint_id, count(DISTINCT chapter) FROM occurrences GROUP BY datapoint_id HAVING count(DISTINCT chapter) > 1""",
    "artifact_references": f"""WITH a AS (SELECT DISTINCT * FROM annotation_pairs), s AS (SELECT file_name, unnest(regexp_extract_all(line, '{inputs._ANY_ID}')) AS id FROM a)
SELECT file_name, count(*) AS mentions, count(DISTINCT s.id) AS ids, count(DISTINCT CASE WHEN k.id IS NULL THEN s.id END) AS unknown FROM s LEFT JOIN (SELECT DISTINCT id FROM segments) k ON k.id = s.id GROUP BY file_name""",
    "run_configs": r"""WITH s AS (SELECT DISTINCT regexp_extract(id, '^([a-z0-9]+)_', 1) AS book, CAST(regexp_extract(id, '_ch(\d{2})_', 1) AS INT) AS chapter FROM segments WHERE regexp_full_match(id, '[a-z0-9]+_[a-z]+_ch\d{2}_p\d{4}_s\d{3}')), p AS (SELECT * FROM (VALUES ('de', 'en'), ('de', 'zh')) v(src_lang, tgt_lang))
SELECT book, chapter, src_lang, tgt_lang, printf('segments/%s/%s/ch%02d.jsonl', book, src_lang, chapter) AS src_path, printf('segments/%s/%s/ch%02d.jsonl', book, tgt_lang, chapter) AS tgt_path, 'full' AS dataset_scope FROM s, p""",
    "cache_outcomes": r"""WITH r AS (SELECT *, regexp_extract(id, '^([a-z0-9]+_[a-z]+_ch\d{2})_', 1) AS scope FROM segments WHERE regexp_matches(id, '^[a-z0-9]+_[a-z]+_ch\d{2}_')),
f AS (SELECT DISTINCT ON (scope, id) scope, id, coalesce(text, '') AS text FROM r WHERE deleted_at IS NULL ORDER BY scope, id, loaded_at NULLS FIRST, coalesce(text, '')),
g AS (SELECT DISTINCT ON (scope, id) scope, id, coalesce(text, '') AS text FROM r WHERE loaded_at < TIMESTAMP '2023-07-01' ORDER BY scope, id, loaded_at NULLS FIRST, coalesce(text, '')),
w AS (SELECT scope, string_agg(id, chr(30) ORDER BY id) AS i, string_agg(id || chr(31) || text, chr(30) ORDER BY id) AS t FROM f GROUP BY 1), c AS (SELECT scope, string_agg(id, chr(30) ORDER BY id) AS i, string_agg(id || chr(31) || text, chr(30) ORDER BY id) AS t FROM g GROUP BY 1)
SELECT CASE WHEN c.i IS NULL THEN 'missing' WHEN c.i <> w.i THEN 'ids_differ' WHEN c.t <> w.t THEN 'texts_differ' ELSE 'hit' END AS outcome, count(*) AS n FROM w LEFT JOIN c USING (scope) GROUP BY ALL""",
    "alignment_manifest": r"""WITH r AS (SELECT *, nullif(regexp_extract(src[1], '^([a-z0-9]+_[a-z]+_ch\d{2})_', 1), '') AS scope FROM alignments),
m AS (SELECT scope, src_lang, tgt_lang, count(*) AS records, count(*) FILTER (needs_review) AS needs_review, round(avg(confidence), 6) AS mean_confidence, sha256(coalesce(string_agg(DISTINCT align_id, ',' ORDER BY align_id), '')) AS ids_digest FROM r WHERE scope IS NOT NULL GROUP BY ALL)
SELECT *, CASE WHEN needs_review > 0.5 * records THEN 'needs_review' ELSE 'ok' END AS status FROM m""",
    "qc_examples": _ISSUES + ", d AS (SELECT DISTINCT issue, id FROM i WHERE issue IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY id NULLS FIRST) AS k FROM d) SELECT issue, id FROM n WHERE k <= 3",
    "text_keys": r"""SELECT coalesce(nullif(regexp_replace(regexp_replace(coalesce(source, ''), '[^A-Za-z0-9.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'model') AS slug, 'query: ' || coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS langs,
  CAST(sum(coalesce(try_cast(regexp_extract(coalesce(text, ''), '([0-9]{1,4})', 1) AS INT), -1)) AS BIGINT) AS numbers FROM documents GROUP BY 1""",
}
