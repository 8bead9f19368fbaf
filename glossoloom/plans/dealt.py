"""Queries of the general data-quality operators and the SQL that says the same."""

from __future__ import annotations

from ..operators import records, references
from ..session import read_table

REFERRING = ("segments", "alignments", "occurrences", "pp_mappings")


def p4_found(spark, sf_dir):
    """Records of annotation_pairs, other than headers, that are no valid annotation rows."""
    checked = records.classify_annotations(read_table(spark, sf_dir, "annotation_pairs"))
    return checked.filter("reason IS NOT NULL").select("file_name", "line_no").distinct()


def p4_reasons(spark, sf_dir):
    """The broken records with reason and offset of the fault."""
    checked = records.classify_annotations(read_table(spark, sf_dir, "annotation_pairs"))
    return checked.filter("reason IS NOT NULL").select("file_name", "line_no", "reason", "offset").distinct()


def p4_valid(spark, sf_dir):
    """The valid records as typed rows: chapter as a number, blanks around vocabulary values trimmed."""
    checked = records.classify_annotations(read_table(spark, sf_dir, "annotation_pairs")).filter("reason IS NULL")
    cols = [f"values.{c}" if c in ("id", "german_sentence") else f"trim(values.{c}) AS {c}" for c in records.ANNOTATION_COLUMNS if c != "chapter"]
    return checked.selectExpr("file_name", "line_no", "int(trim(values.chapter)) AS chapter", *cols).distinct()


def p6_found(spark, sf_dir):
    """Orphan references of the corpus by table, field and month."""
    return references.corpus_orphans(*[read_table(spark, sf_dir, t) for t in REFERRING])


def p6_report(spark, sf_dir):
    """Orphan references and missing targets counted per table, field and month."""
    return references.orphans_by_period(p6_found(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_reasons": p4_reasons, "p4_valid": p4_valid, "p6_found": p6_found, "p6_report": p6_report}

_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
_IN = lambda values, blank: ", ".join(f"'{v}'" for v in [*values, *([""] if blank else [])])
_INDEX = {c: i + 1 for i, c in enumerate(records.ANNOTATION_COLUMNS)}
_V = lambda c: f"v[{_INDEX[c]}]"
#: A record is cut by a regular expression here, which needs no automaton because it sees the record whole.
_P4 = f"""
WITH raw AS (
  SELECT file_name, line_no, CASE WHEN ends_with(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END AS t
  FROM annotation_pairs WHERE line_no <> 1
), cells AS (
  SELECT file_name, line_no, t, list_transform(
    regexp_extract_all(',' || t, ',((?:"(?:[^"]|"")*"|[^",]*))', 1),
    lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS u
  FROM raw
), trimmed AS (
  SELECT *, list_transform(u, lambda x: regexp_replace(x, '^[\\s\\x{{3000}}\\x{{a0}}]+|[\\s\\x{{3000}}\\x{{a0}}]+$', '', 'g')) AS v FROM cells
), judged AS (
  SELECT file_name, line_no, u, coalesce(
    regexp_full_match(t, '{_FIELD}(?:,{_FIELD}){{22}}')
    AND regexp_full_match({_V("chapter")}, '0*[1-9][0-9]?')
    AND {_V("form")} IN ('contracted', 'uncontracted')
    AND regexp_full_match({_V("row_hash")}, '[0-9a-f]{{64}}')
    AND {_V("de_valid")} IN ('include', 'exclude', '')
    AND CASE WHEN {_V("de_valid")} = 'exclude' THEN {_V("de_exclusion_reason")} IN ({_IN(records.EXCLUSION_REASONS, False)}) ELSE {_V("de_exclusion_reason")} = '' END
    AND {_V("en_form")} IN ({_IN(records.EN_FORMS, True)}) AND {_V("zh_form")} IN ({_IN(records.ZH_FORMS, True)})
    AND {_V("en_alignment_confidence")} IN ({_IN(records.CONFIDENCES, True)})
    AND {_V("zh_alignment_confidence")} IN ({_IN(records.CONFIDENCES, True)}), false) AS ok
  FROM trimmed
)
"""
_P4_FOUND = _P4 + "SELECT DISTINCT file_name, line_no FROM judged WHERE NOT ok"
_TYPED = ", ".join(f"u[{i}] AS {c}" if c in ("id", "german_sentence") else f"CAST(trim(u[{i}]) AS INT) AS chapter" if c == "chapter" else f"trim(u[{i}]) AS {c}" for c, i in _INDEX.items())
_P4_VALID = _P4 + f"SELECT DISTINCT file_name, line_no, {_TYPED} FROM judged WHERE ok"

_P6 = """
WITH refs AS (
  SELECT 'alignments' AS ref_table, 'src' AS ref_field, align_id AS ref_id, unnest(src) AS target_id, loaded_at FROM alignments
  UNION ALL SELECT 'alignments', 'tgt', align_id, unnest(tgt), loaded_at FROM alignments
  UNION ALL SELECT 'occurrences', 'source_segment_id', datapoint_id, source_segment_id, loaded_at FROM occurrences
  UNION ALL SELECT 'pp_mappings', 'datapoint_id', mapping_id, datapoint_id, loaded_at FROM pp_mappings
), targets AS (
  SELECT 'segment' AS kind, id AS key, loaded_at, deleted_at FROM segments
  UNION ALL SELECT 'occurrence', datapoint_id, loaded_at, deleted_at FROM occurrences
), found AS (
  SELECT r.ref_table, r.ref_field, r.ref_id, r.target_id, strftime(r.loaded_at, '%Y-%m') AS period,
         bool_or(t.key IS NOT NULL AND date_trunc('month', t.loaded_at) <= date_trunc('month', r.loaded_at)
                 AND (t.deleted_at IS NULL OR date_trunc('month', t.deleted_at) > date_trunc('month', r.loaded_at))) AS alive
  FROM refs r LEFT JOIN targets t
    ON t.key = r.target_id AND t.kind = CASE r.ref_table WHEN 'pp_mappings' THEN 'occurrence' ELSE 'segment' END
  WHERE r.target_id IS NOT NULL
  GROUP BY ALL
)
"""
_P6_FOUND = _P6 + "SELECT ref_table, ref_field, ref_id, target_id, period FROM found WHERE NOT alive"

ORACLE = {
    "p4_found": _P4_FOUND,
    "p4_valid": _P4_VALID,
    "p6_found": _P6_FOUND,
    "p6_report": _P6 + """
SELECT ref_table, ref_field, period, count(*) AS orphans, count(DISTINCT target_id) AS targets
FROM found WHERE NOT alive GROUP BY ref_table, ref_field, period""",
}
