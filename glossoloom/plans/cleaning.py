"""Queries over blocks, paragraphs, parsed blocks and plain text, with the SQL that says the same. Keys carry the inventory's ids in their docstrings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as X
from ..operators import audit, clean, segment, trees
from ..session import read_table
from ..sources import files

#: White space as Java and Python have it, for RE2.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ABBREVIATIONS = ("Dr.", "Prof.", "St.", "Nr.", "z. B.", "d. h.", "usw.", "ca.", "Mr.", "Mrs.", "etc.", "e.g.", "i.e.", "p.m.", "approx.")
NOTE_SIZES = (9.0, 11.0)
OPENING = {"de": "„", "en": "“", "zh": "“"}


def _blocks(spark, d):
    return clean.first_loaded(read_table(spark, d, "ocr_blocks"), "block_id", "text")


def _paragraphs(spark, d, *langs):
    return clean.first_loaded(read_table(spark, d, "paragraphs").filter(F.col("lang").isin(*langs)), "paragraph_id", "text")


def normalize_block(spark, d):
    """FN-01, FN-02, PRJ: block text on one line."""
    return _blocks(spark, d).select("block_id", C.normalize_block("text").alias("norm"))


def _classified(spark, d):
    blocks = _blocks(spark, d)
    return clean.mark_titles(clean.classify_blocks(blocks), clean.running_titles(blocks))


def block_reasons(spark, d):
    """FLT-01..10, WIN-06, AGG-10: why blocks leave the body; the running titles of each book are learned from its pages."""
    rows = _classified(spark, d)
    return rows.groupBy("book", "lang", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def bbox_outliers(spark, d):
    """FLT-09, FLT-10, JOIN-28: recognised blocks far right of their page."""
    return clean.mark_outliers(_blocks(spark, d)).filter("outlier").select("block_id")


def indent_thresholds(spark, d):
    """AGG-16, AGG-17, WIN-13: left margin and indent threshold of pages."""
    return clean.page_thresholds(_blocks(spark, d)).select("book", "lang", "chapter", "page", "margin", "threshold")


def paragraphs_of(spark, d):
    """Paragraphs assembled from the blocks that are kept."""
    return clean.assemble_paragraphs(_classified(spark, d).filter("reason IS NULL"), OPENING)


def paragraph_assembly(spark, d):
    """PRC-01, PRC-03, WIN-02, FN-04, FN-05, PRJ-21, SRT-01: paragraphs of cleaned blocks."""
    return paragraphs_of(spark, d).select("book", "lang", "chapter", "paragraph", "text", "page", "source_pages")


def span_notes(spark, d):
    """PRC-02, FLT-11, FLT-12, FN-03: notes and markers by font size."""
    rows = clean.span_notes(_blocks(spark, d), *NOTE_SIZES)
    return rows.select("block_id", F.size("notes").alias("notes"), F.length("text").alias("chars"))


def confidence_summary(spark, d):
    """AGG-01: recognition confidence by book and language."""
    rows = clean.confidence_summary(_blocks(spark, d), ["book", "lang"])
    return rows.select("book", "lang", "n", F.round("mean", 6).alias("mean"), "median", "p10", "low")


def wordlist(spark, d):
    """AGG-14, AGG-15, FN-20: words that occur twice or more."""
    return clean.wordlist(read_table(spark, d, "paragraphs").filter("lang = 'de'"))


def stuck_words(spark, d):
    """FN-09..11, JOIN-29, SRT-08: words stuck together, separated by the words of the corpus."""
    texts = read_table(spark, d, "paragraphs").filter("lang = 'de'").select("paragraph_id", "text").distinct()
    return clean.split_stuck_words(texts, clean.wordlist(texts)).filter("split <> text").select("paragraph_id", "split")


def text_layer(spark, d):
    """SRC-03: does a chapter have a text layer?"""
    return files.text_layer(_blocks(spark, d), ["book", "lang", "chapter"])


def sentence_split(spark, d):
    """FN-06, FLT-14, PRJ-01, WIN-01, MSC-03: German and English sentences with ids."""
    cut = segment.segments_of(_paragraphs(spark, d, "de", "en"), {"de": ABBREVIATIONS, "en": ABBREVIATIONS})
    return cut.select("id", "text")


def zh_split(spark, d):
    """FN-07, FN-08, FLT-13, FLT-15: Chinese sentences with the quotation rule."""
    return segment.segments_of(_paragraphs(spark, d, "zh")).select("id", "text")


def contracted_plain(spark, d):
    """FN-15: contracted prepositions of plain text, with their canonical form."""
    pattern = rf"(?iu)(?<![\p{{L}}])({'|'.join(X.CONTRACTIONS_PLAIN)})(?![\p{{L}}])"
    words = read_table(spark, d, "documents").filter("lang = 'de'").select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("w"))
    return words.groupBy(F.lower("w").alias("form")).agg(F.count(F.lit(1)).alias("n")).withColumn("canonical", C.canonical_prep("form"))


def uncontracted_plain(spark, d):
    """FN-16: prepositions directly before a definite article."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    rows = read_table(spark, d, "documents").filter("lang = 'de'").select(tokens.alias("t")).filter(F.size("t") > 1)
    pairs = F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.struct(a.alias("prep"), b.alias("det")))
    hits = rows.select(F.explode(F.filter(pairs, lambda p: p["prep"].isin(*X.PREPOSITIONS) & p["det"].isin(*X.DEFINITE_ARTICLES))).alias("p"))
    return hits.groupBy("p.prep", "p.det").agg(F.count(F.lit(1)).alias("n"))


def conllu_blocks(spark, d):
    """SRC-24..27, FLT-31: blocks of parsed documents."""
    docs = read_table(spark, d, "documents").filter("kind = 'parsed'")
    rows = trees.parse_blocks(trees.document_blocks(docs))
    return rows.select("doc_id", "ord", "sent_text", F.size("tokens").alias("tokens"), F.array_join(F.transform("tokens", lambda t: t["form"]), " ").alias("forms"))


def block_ordinals(spark, d):
    """PRJ-03: segment and ordinal in block ids."""
    rows = read_table(spark, d, "occurrences").select(F.lit("all").alias("doc_id"), F.col("parse_block_id").alias("sent_id"), "source_segment_id").distinct()
    parts = C.block_parts("sent_id")
    return rows.select("sent_id", parts["segment"].alias("segment"), parts["ordinal"].alias("ordinal"), (parts["segment"] == F.col("source_segment_id")).alias("same_segment"))


def provenance_counts(spark, d):
    """AGG-11, AGG-12, AGG-26: blocks per segment."""
    rows = read_table(spark, d, "occurrences").select("chapter", F.col("parse_block_id").alias("sent_id"), "source_segment_id").filter("source_segment_id IS NOT NULL")
    return trees.provenance_counts(rows, ["chapter"])


def parsed_blocks(spark, d):
    """Blocks of the parsed documents with their tokens."""
    docs = read_table(spark, d, "documents").filter("kind = 'parsed'")
    return trees.parse_blocks(trees.document_blocks(docs))


def pp_state_machine(spark, d):
    """PRC-08, PRJ-18, FLT-30, SET-01: phrases of all parsed documents by the token state machine, over shallow tags."""
    rows = parsed_blocks(spark, d).withColumn("tokens", trees.chunk_tags("tokens"))

    def of_form(name, forms):
        return F.transform(trees.extract_phrases("tokens", forms, name == "contracted"), lambda p: p.withField("form", F.lit(name)))

    both = F.concat(of_form("contracted", tuple(X.CONTRACTIONS)), of_form("uncontracted", X.PREPOSITIONS))
    hits = rows.select("doc_id", "ord", "tokens", F.explode(both).alias("p"))
    return hits.select("doc_id", "ord", "p.form", "p.prep", "p.det", "p.noun", trees.surface("tokens", "p.prep_token_id", "p.noun_token_id").alias("surface"))


def ud_phrases(spark, d):
    """PRC-09, JOIN-13, JOIN-14, PRJ-19, FLT-17, FLT-18: phrases of all parsed documents by dependencies, over shallow tags."""
    rows = parsed_blocks(spark, d).withColumn("tokens", trees.chunk_tags("tokens")).select("doc_id", "ord", F.explode(trees.case_phrases("tokens")).alias("p"))
    return rows.select("doc_id", "ord", "p.prep_surface", "p.head_lemma", "p.span_text", F.array_join(F.transform("p.span_token_ids", lambda i: i.cast("string")), ",").alias("ids"))


def mwt_collapse(spark, d):
    """PRC-10, PRC-11, SNK-03, SNK-04: tokens of the parsed documents, multiword ones as one, renumbered."""
    rows = parsed_blocks(spark, d).withColumn("t", trees.collapse_ranges("tokens"))
    return rows.select("doc_id", "ord", F.array_join(F.transform("t", lambda x: F.concat_ws("/", x["id"], x["form"], x["head"])), " ").alias("tokens"))


def char_offsets(spark, d):
    """PRJ-20: offsets of the tokens of parsed documents in their sentence."""
    rows = parsed_blocks(spark, d).withColumn("forms", F.transform(trees.words_only("tokens"), lambda t: t["form"]))
    return rows.select("doc_id", "ord", trees.token_offsets("sent_text", "forms").alias("offsets"))


def block_counts(spark, d):
    """CHK-19, MSC-04: physical blocks of a parsed document against those with tokens and those with a sentence comment."""
    rows = parsed_blocks(spark, d)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("physical"), F.count_if(F.size("tokens") > 0).alias("parsed"), F.count_if(F.col("sent_text").isNotNull()).alias("named"))


def _occurrence_blocks(spark, d):
    """Blocks that occurrences stand in, as a scan of the files of their chapters would give them."""
    rows = read_table(spark, d, "occurrences").select("chapter", F.col("parse_block_id").alias("sent_id"), "source_segment_id", "pp_token_start").distinct()
    order = W.partitionBy("chapter", F.regexp_extract(F.coalesce("sent_id", F.lit("")), r"^(.*?)(#|$)", 1)).orderBy("sent_id", "source_segment_id", "pp_token_start")
    return rows.withColumn("ord", F.row_number().over(order))


def provenance_faults(spark, d):
    """SRC-25, CHK-02, MSC-05: first fault of the blocks that occurrences stand in."""
    rows = trees.provenance_faults(_occurrence_blocks(spark, d).groupBy("chapter", "sent_id", "source_segment_id").agg(F.min("ord").alias("ord")), "chapter")
    return rows.groupBy("chapter", "rule").agg(F.count(F.lit(1)).alias("n"))


def block_migration(spark, d):
    """PRC-13, WIN-03, WIN-04, AGG-26: ordinals given to blocks whose ids have none, in document order."""
    rows = _occurrence_blocks(spark, d).select("chapter", "ord", F.regexp_replace("sent_id", r"#b[0-9]{3,}$", "").alias("sent_id")).filter("sent_id IS NOT NULL")
    return trees.number_blocks(rows, "chapter").select("chapter", "sent_id", "ordinal", "new_id")


def id_parts(spark, d):
    """PRJ-02, FLT-16: parts of segment ids, malformed ones as nulls."""
    rows = read_table(spark, d, "occurrences").select(F.col("source_segment_id").alias("id")).filter("id IS NOT NULL").distinct()
    return rows.select("id", *[c.alias(k) for k, c in C.segment_parts("id").items()], C.scope_of("id").alias("scope"))


def page_runs(spark, d):
    """SRC-38, WIN-18: runs of consecutive pages of chapters."""
    rows = _blocks(spark, d).select("book", "lang", "chapter", F.col("page").alias("row")).distinct()
    return audit.runs_of_rows(rows, ["book", "lang", "chapter"], 2)


NAMES = """normalize_block block_reasons bbox_outliers indent_thresholds paragraph_assembly span_notes confidence_summary wordlist stuck_words text_layer sentence_split zh_split
contracted_plain uncontracted_plain conllu_blocks block_ordinals provenance_counts pp_state_machine ud_phrases mwt_collapse char_offsets id_parts page_runs block_counts provenance_faults block_migration""".split()
QUERIES = {n: globals()[n] for n in NAMES}

_B = "(SELECT DISTINCT ON (block_id) * FROM ocr_blocks ORDER BY block_id, loaded_at NULLS FIRST, text NULLS FIRST)"
_SUB = lambda x, p, r: f"regexp_replace({x}, '{p}', '{r}', 'g')"
_STRIP = lambda x: _SUB(x, f"^{WS}+|{WS}+$", "")
_PLAIN = _SUB("text", r"[\x{7f}-\x{9f}]", "")
_NORM = f"(CASE WHEN starts_with({_PLAIN}, chr(12288)) THEN chr(12288) ELSE '' END || {_STRIP(_SUB(_SUB(_PLAIN, '([A-Za-zÄÖÜäöüß])-[\\n\\r]+([a-zäöüß])', '\\1\\2'), WS + '+', ' '))})"
_VALID = "(len(bbox) >= 4 AND bbox[3] > bbox[1] AND bbox[1] > 0)"
_LIST = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
_CLASSIFIED = f"""
medians AS (SELECT book, lang, chapter, page, list_sort(list(bbox[1]) FILTER (WHERE {_VALID})) AS xs FROM {_B} GROUP BY ALL),
normed AS (SELECT b.*, coalesce({_NORM}, '') AS norm, coalesce(b.engine = 'paddleocr' AND {_VALID} AND bbox[1] > 3 * xs[len(xs) // 2 + 1], false) AS outlier
  FROM {_B} b JOIN medians USING (book, lang, chapter, page)),
titles AS (SELECT book, lang, title FROM (SELECT book, lang, chapter, page, lower({_SUB('text', '[^\\p{L}]', '')}) AS title, {_STRIP('text')} AS line, {_SUB(_STRIP('text'), '^\\d{1,4}\\s{2,}|\\s{2,}\\d{1,4}$', '')} AS bare FROM {_B})
  WHERE NOT contains(line, chr(10)) AND regexp_matches(bare, '^[\\p{{Lu}}\\p{{Han}}]') AND NOT regexp_matches(bare, '[.!?,;:…。！？，；：、“”„»«「」()（）\\d-]') AND length(title) >= 3
  GROUP BY book, lang, title HAVING count(DISTINCT (chapter, page)) >= 2),
reasoned AS (SELECT *, CASE WHEN outlier THEN 'outlier' WHEN norm = '' THEN 'empty' WHEN confidence < 0.4 THEN 'low_confidence'
  WHEN regexp_full_match({_STRIP('norm')}, '\\d{{1,4}}') THEN 'page_number'
  WHEN regexp_full_match(norm, '(?:[{X.ORNAMENTS}]|{WS})+') THEN 'decorative'
  WHEN regexp_full_match({_STRIP('norm')}, '\\p{{L}}') THEN 'single_letter' END AS r FROM normed),
classified AS (SELECT b.* EXCLUDE (r), coalesce(r, CASE WHEN t.title IS NOT NULL AND NOT contains({_STRIP('text')}, chr(10)) THEN 'header' END) AS reason
  FROM reasoned b LEFT JOIN titles t ON t.book IS NOT DISTINCT FROM b.book AND t.lang IS NOT DISTINCT FROM b.lang AND t.title = lower({_SUB('b.text', '[^\\p{L}]', '')}))"""
_PAGES = lambda src: f"""pages AS (SELECT book, lang, chapter, page, list_sort(list(bbox[1])) AS xs, list_sort(list_distinct(list(bbox[1]) FILTER (WHERE {_VALID}))) AS us
  FROM {src} WHERE len(bbox) >= 4 GROUP BY ALL),
margins AS (SELECT *, xs[CAST(round_even(0.1 * (len(xs) - 1), 0) AS INT) + 1] AS margin FROM pages),
gaps AS (SELECT *, list_filter(us, lambda x: x <= 2.5 * margin) AS body FROM margins),
bests AS (SELECT *, list_max(list_transform(range(1, len(body)), lambda i: {{'gap': body[i + 1] - body[i], 'neg': -body[i]}})) AS best FROM gaps),
thresholds AS (SELECT book, lang, chapter, page, margin, CASE WHEN coalesce(len(us), 0) = 0 THEN NULL WHEN best.gap >= 30 THEN -best.neg + best.gap / 2 ELSE margin + 50 END AS threshold FROM bests)"""  # noqa: E731
_STOP, _DOTS, _ELLIPSIS = "chr(57344)", "chr(57345)", "chr(57346)"
_MASK = f"replace(replace(regexp_replace(text, '(?:\\.{WS}+){{2,}}\\.', '…', 'g'), '...', {_DOTS}), '…', {_ELLIPSIS})"
for _a in sorted(ABBREVIATIONS, key=lambda a: (-len(a), a)):
    _MASK = f"replace({_MASK}, '{_a}', replace('{_a}', '.', {_STOP}))"

_TOKENS = r"""WITH b AS (SELECT doc_id, list_filter(string_split_regex(text, '\n[ \t]*\n+'), lambda x: regexp_matches(x, '[^\s]')) AS bs FROM documents WHERE kind = 'parsed'),
u AS (SELECT doc_id, unnest(bs) AS text, CAST(generate_subscripts(bs, 1) AS INT) AS ord FROM b),
t AS (SELECT doc_id, ord, nullif(regexp_extract(text, '(?m)^#\s*text\s*=\s*(.*?)\s*$', 1), '') AS sent_text, list_filter(list_transform(list_filter(string_split_regex(text, '\r?\n'), lambda x: regexp_matches(x, '^\d+(-\d+)?\t')), lambda x: string_split(x, chr(9))), lambda c: len(c) >= 8) AS cells FROM u)"""
#: Tokens with the chunker's tags; a segment runs up to its noun.
_TAGGED = f"""{_TOKENS}, w AS (SELECT doc_id, ord, unnest(cells) AS c, generate_subscripts(cells, 1) AS i FROM t),
k AS (SELECT doc_id, ord, i, c[2] AS form, c[3] AS lemma, regexp_matches(c[2], '^\\p{{Lu}}') AND i > 1 AS noun, c[2] IN ({_LIST(X.CONTRACTIONS)}) AS contracted, c[2] IN ({_LIST(X.PREPOSITIONS)}) AS prep,
  lower(c[2]) IN ({_LIST([*X.CONTRACTIONS, *X.PREPOSITIONS])}) AS adp, lower(c[2]) IN ({_LIST(X.DEFINITE_ARTICLES)}) AND NOT (regexp_matches(c[2], '^\\p{{Lu}}') AND i > 1) AS det, c[2] IN ({_LIST(X.DETERMINERS)}) AS article FROM w),
tagged AS (SELECT *, coalesce(sum(CAST(noun AS INT)) OVER (PARTITION BY doc_id, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM k)"""

ORACLE = {
    "normalize_block": f"SELECT block_id, {_NORM} AS norm FROM {_B}",
    "block_reasons": f"WITH {_CLASSIFIED} SELECT book, lang, coalesce(reason, 'kept') AS reason, count(*) AS n FROM classified GROUP BY ALL",
    "bbox_outliers": f"WITH {_CLASSIFIED} SELECT block_id FROM classified WHERE outlier",
    "indent_thresholds": f"WITH {_PAGES(_B)} SELECT * FROM thresholds",
    "paragraph_assembly": f"""WITH {_CLASSIFIED}, kept AS (SELECT * FROM classified WHERE reason IS NULL), {_PAGES('kept')},
lagged AS (SELECT k.*, t.threshold, {_STRIP('norm')} AS t, lag({_STRIP('norm')}) OVER w AS before FROM kept k LEFT JOIN thresholds t USING (book, lang, chapter, page)
  WINDOW w AS (PARTITION BY k.book, k.lang, k.chapter ORDER BY page, block_idx, block_id)),
opened AS (SELECT *, before IS NULL OR starts_with(norm, chr(12288)) OR coalesce(CASE WHEN threshold IS NOT NULL AND {_VALID} THEN bbox[1] > threshold ELSE starts_with(norm, '    ') END, false)
    OR (instr('{X.TERMINATORS.replace("'", "''")}', right(before, 1)) > 0 AND (lang = 'en' OR starts_with(t, CASE lang WHEN 'de' THEN '„' ELSE '“' END))) AS opens,
  before LIKE '%-' AND regexp_matches(t, '^\\p{{Ll}}') AS heal FROM lagged),
counted AS (SELECT *, CAST(sum(CAST(opens AS INT)) OVER w AS INT) AS paragraph, lead(heal AND NOT opens) OVER w AS next_heals FROM opened
  WINDOW w AS (PARTITION BY book, lang, chapter ORDER BY page, block_idx, block_id))
SELECT book, lang, chapter, paragraph, {_STRIP(_SUB("string_agg((CASE WHEN opens OR heal THEN '' WHEN lang IN ('de', 'en') THEN ' ' ELSE '' END) || CASE WHEN next_heals THEN left(t, length(t) - 1) ELSE t END, '' ORDER BY page, block_idx, block_id)", WS + '+', ' '))} AS text,
  min(page) AS page, list_sort(list_distinct(list(page))) AS source_pages FROM counted GROUP BY ALL""",
    "span_notes": f"""WITH cut AS (SELECT block_id, text, lines, coalesce(len(lines), 0) > 0 AS has, list_transform(coalesce(lines, []), lambda x: {{'rest': list_filter(x.spans, lambda s: NOT (s.size < {NOTE_SIZES[0]} AND regexp_full_match(trim(s.text), '\\d{{1,2}}'))), 'n': len(x.spans)}}) AS ls FROM {_B}),
told AS (SELECT *, list_transform(ls, lambda x: {{'text': list_aggregate(list_transform(x.rest, lambda s: s.text), 'string_agg', ''), 'note': len(x.rest) < x.n AND len(x.rest) > 0 AND len(list_filter(x.rest, lambda s: s.size >= {NOTE_SIZES[1]})) = 0}}) AS ts FROM cut)
SELECT block_id, CAST(len(list_filter(ts, lambda x: x.note AND x.text <> '')) AS INT) AS notes,
  CAST(length(CASE WHEN has THEN coalesce(list_aggregate(list_transform(list_filter(ts, lambda x: NOT x.note), lambda x: coalesce(x.text, '')), 'string_agg', chr(10)), '') ELSE text END) AS INT) AS chars FROM told""",
    "confidence_summary": f"""WITH s AS (SELECT book, lang, list_sort(list(confidence)) AS c FROM {_B} GROUP BY ALL)
SELECT book, lang, len(c) AS n, round(list_avg(c), 6) AS mean, c[len(c) // 2 + 1] AS median, c[greatest(1, CAST(floor(0.1 * len(c)) AS INT))] AS p10, len(list_filter(c, lambda x: x < 0.6)) AS low FROM s""",
    "wordlist": "WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-zÄÖÜäöüß]+')) AS word FROM paragraphs WHERE lang = 'de'), k AS (SELECT word FROM w GROUP BY word HAVING count(*) >= 2) SELECT word FROM k UNION SELECT lower(word) FROM k",
    "text_layer": f"""WITH p AS (SELECT book, lang, chapter, page, sum(length(trim(coalesce(text, '')))) AS chars FROM {_B} GROUP BY ALL), l AS (SELECT book, lang, chapter, list(chars ORDER BY page) AS c FROM p GROUP BY ALL)
SELECT book, lang, chapter, list_median(list_transform(range(0, least(5, len(c))), lambda i: c[CAST(floor(i * len(c) / least(5, len(c))) AS INT) + 1])) > 50 AS has_layer FROM l""",
    "sentence_split": f"""WITH p AS (SELECT DISTINCT ON (paragraph_id) * FROM paragraphs WHERE lang IN ('de', 'en') ORDER BY paragraph_id, loaded_at NULLS FIRST, text NULLS FIRST),
m AS (SELECT *, regexp_replace({_MASK}, '([.!?]["'')\\]»«]?)({WS}|$)', '\\1' || chr(1) || '\\2', 'g') AS t FROM p),
u AS (SELECT book, lang, chapter, paragraph, list_filter(list_transform(string_split(t, chr(1)), lambda x: {_STRIP(f"replace(replace(replace(x, {_STOP}, '.'), {_DOTS}, '...'), {_ELLIPSIS}, '…')")}), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS parts FROM m),
e AS (SELECT book, lang, chapter, paragraph, unnest(parts) AS text, generate_subscripts(parts, 1) AS i FROM u)
SELECT printf('%s_%s_ch%02d_p%04d_s%03d', book, lang, chapter, paragraph, CAST(i AS INT)) AS id, text FROM e""",
    "contracted_plain": f"""WITH w AS (SELECT unnest(regexp_extract_all(text, '\\p{{L}}+')) AS w FROM documents WHERE lang = 'de'), f AS (SELECT lower(w) AS form, count(*) AS n FROM w WHERE lower(w) IN ({_LIST(X.CONTRACTIONS_PLAIN)}) GROUP BY ALL)
SELECT form, n, CASE form {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in X.CONTRACTIONS.items())} END AS canonical FROM f""",
    "uncontracted_plain": f"""WITH t AS (SELECT regexp_extract_all(lower(text), '\\p{{L}}+') AS t FROM documents WHERE lang = 'de'), p AS (SELECT unnest(list_zip(t[:len(t) - 1], t[2:])) AS p FROM t WHERE len(t) > 1)
SELECT p[1] AS prep, p[2] AS det, count(*) AS n FROM p WHERE p[1] IN ({_LIST(X.PREPOSITIONS)}) AND p[2] IN ({_LIST(X.DEFINITE_ARTICLES)}) GROUP BY ALL""",
    "conllu_blocks": r"""WITH b AS (SELECT doc_id, list_filter(string_split_regex(text, '\n[ \t]*\n+'), lambda x: regexp_matches(x, '[^\s]')) AS bs FROM documents WHERE kind = 'parsed'),
u AS (SELECT doc_id, unnest(bs) AS text, CAST(generate_subscripts(bs, 1) AS INT) AS ord FROM b),
t AS (SELECT doc_id, ord, nullif(regexp_extract(text, '(?m)^#\s*text\s*=\s*(.*?)\s*$', 1), '') AS sent_text, list_filter(list_transform(list_filter(string_split_regex(text, '\r?\n'), lambda x: regexp_matches(x, '^\d+(-\d+)?\t')), lambda x: string_split(x, chr(9))), lambda c: len(c) >= 8) AS cells FROM u)
SELECT doc_id, ord, sent_text, CAST(len(cells) AS INT) AS tokens, coalesce(list_aggregate(list_transform(cells, lambda c: c[2]), 'string_agg', ' '), '') AS forms FROM t""",
    "block_ordinals": r"""WITH r AS (SELECT DISTINCT parse_block_id AS sent_id, source_segment_id FROM occurrences), p AS (SELECT *, regexp_extract(sent_id, '^(.+)#b(\d{3,})$', 1) AS s, try_cast(regexp_extract(sent_id, '^(.+)#b(\d{3,})$', 2) AS INT) AS o FROM r)
SELECT sent_id, CASE WHEN o >= 1 THEN s END AS segment, CASE WHEN o >= 1 THEN o END AS ordinal, CASE WHEN o >= 1 THEN s END = source_segment_id AS same_segment FROM p""",
    "provenance_counts": """WITH p AS (SELECT chapter, source_segment_id, count(*) AS n, count(DISTINCT parse_block_id) AS ids FROM occurrences WHERE source_segment_id IS NOT NULL GROUP BY ALL)
SELECT chapter, CAST(sum(n) AS BIGINT) AS blocks, CAST(sum(ids) AS BIGINT) AS ids, count(*) AS segments, count(*) FILTER (n > 1) AS multi_block, max(n) AS most FROM p GROUP BY chapter""",
    "pp_state_machine": f"""{_TAGGED}, per AS (SELECT doc_id, ord, seg, any_value(form) FILTER (noun) AS surface_noun, any_value(lemma) FILTER (noun) AS noun, min(i) FILTER (noun) AS j,
  list_sort(list(i) FILTER (contracted))[-1] AS c, list_sort(list(i) FILTER (prep))[-1] AS p, min(i) FILTER (prep) AS p1 FROM tagged GROUP BY ALL HAVING min(i) FILTER (noun) IS NOT NULL),
found AS (SELECT doc_id, ord, seg, 'contracted' AS form, c AS at, NULL::BIGINT AS d, noun, j FROM per WHERE c IS NOT NULL
  UNION ALL SELECT q.doc_id, q.ord, q.seg, 'uncontracted', q.p, max(t.i), q.noun, q.j FROM per q JOIN tagged t ON t.doc_id = q.doc_id AND t.ord = q.ord AND t.seg = q.seg AND t.article AND t.i > q.p1 WHERE p IS NOT NULL GROUP BY ALL)
SELECT f.doc_id, f.ord, f.form, a.form AS prep, b.form AS det, f.noun, (SELECT string_agg(s.form, ' ' ORDER BY s.i) FROM tagged s WHERE s.doc_id = f.doc_id AND s.ord = f.ord AND s.i BETWEEN f.at AND f.j) AS surface
FROM found f JOIN tagged a ON a.doc_id = f.doc_id AND a.ord = f.ord AND a.i = f.at LEFT JOIN tagged b ON b.doc_id = f.doc_id AND b.ord = f.ord AND b.i = f.d""",
    "ud_phrases": f"""{_TAGGED}, nouns AS (SELECT * FROM tagged WHERE noun)
SELECT a.doc_id, a.ord, a.form AS prep_surface, n.lemma AS head_lemma, string_agg(m.form, ' ' ORDER BY m.i) AS span_text, string_agg(CAST(m.i AS VARCHAR), ',' ORDER BY m.i) AS ids
FROM tagged a JOIN nouns n ON n.doc_id = a.doc_id AND n.ord = a.ord AND n.seg = a.seg JOIN tagged m ON m.doc_id = a.doc_id AND m.ord = a.ord AND m.seg = a.seg AND (m.i = a.i OR m.i = n.i OR m.det)
WHERE a.adp AND NOT a.noun GROUP BY a.doc_id, a.ord, a.i, a.form, n.lemma""",
    "mwt_collapse": f"{_TOKENS} SELECT doc_id, ord, coalesce(list_aggregate(list_transform(range(1, len(cells) + 1), lambda i: i || '/' || cells[i][2] || '/' || cells[i][7]), 'string_agg', ' '), '') AS tokens FROM t",
    "char_offsets": f"""{_TOKENS}, f AS (SELECT doc_id, ord, sent_text, list_transform(cells, lambda c: c[2]) AS w, list_transform(cells, lambda c: CAST(length(c[2]) AS INT)) AS n FROM t)
SELECT doc_id, ord, CASE WHEN sent_text IS NULL OR len(n) = 0 THEN [] ELSE list_transform(range(1, len(n) + 1), lambda i: CASE WHEN substr(sent_text, CAST(coalesce(list_sum(n[:i - 1]), 0) + i AS INT), n[i]) = w[i]
  THEN [CAST(coalesce(list_sum(n[:i - 1]), 0) + i - 1 AS INT), CAST(coalesce(list_sum(n[:i]), 0) + i - 1 AS INT)] END) END AS offsets FROM f""",
    "block_counts": f"{_TOKENS} SELECT doc_id, count(*) AS physical, count(*) FILTER (len(cells) > 0) AS parsed, count(sent_text) AS named FROM t GROUP BY doc_id",
    "provenance_faults": r"""WITH r AS (SELECT DISTINCT chapter, parse_block_id AS sent_id, source_segment_id, pp_token_start FROM occurrences),
o AS (SELECT *, row_number() OVER (PARTITION BY chapter, regexp_extract(coalesce(sent_id, ''), '^(.*?)(#|$)', 1) ORDER BY sent_id NULLS FIRST, source_segment_id NULLS FIRST, pp_token_start NULLS FIRST) AS ord FROM r),
b AS (SELECT chapter, sent_id, source_segment_id, min(ord) AS ord FROM o GROUP BY ALL),
p AS (SELECT *, regexp_extract(sent_id, '^(.+)#b(\d{3,})$', 1) AS s, try_cast(regexp_extract(sent_id, '^(.+)#b(\d{3,})$', 2) AS INT) AS g FROM b),
q AS (SELECT *, CASE WHEN g >= 1 THEN g END AS given, coalesce(CASE WHEN g >= 1 THEN s END, sent_id) AS segment FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY chapter, segment ORDER BY ord) AS ordinal, row_number() OVER (PARTITION BY chapter, sent_id ORDER BY ord) AS copies FROM q),
f AS (SELECT chapter, CASE WHEN sent_id IS NULL THEN 'orphan_block' WHEN given IS NULL THEN 'unmigrated' WHEN source_segment_id IS NULL THEN 'missing_source' WHEN source_segment_id <> segment THEN 'prefix_mismatch' WHEN copies > 1 THEN 'duplicate' WHEN given <> ordinal THEN 'ordinal_gap' END AS rule FROM n)
SELECT chapter, rule, count(*) AS n FROM f WHERE rule IS NOT NULL GROUP BY ALL""",
    "block_migration": r"""WITH r AS (SELECT DISTINCT chapter, parse_block_id AS sent_id, source_segment_id, pp_token_start FROM occurrences),
o AS (SELECT *, row_number() OVER (PARTITION BY chapter, regexp_extract(coalesce(sent_id, ''), '^(.*?)(#|$)', 1) ORDER BY sent_id NULLS FIRST, source_segment_id NULLS FIRST, pp_token_start NULLS FIRST) AS ord FROM r),
s AS (SELECT chapter, ord, regexp_replace(sent_id, '#b[0-9]{3,}$', '') AS sent_id FROM o WHERE sent_id IS NOT NULL),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY chapter, sent_id ORDER BY ord) AS INT) AS ordinal FROM s)
SELECT chapter, sent_id, ordinal, printf('%s#b%03d', sent_id, ordinal) AS new_id FROM n""",
    "id_parts": r"""WITH r AS (SELECT DISTINCT source_segment_id AS id FROM occurrences WHERE source_segment_id IS NOT NULL), p AS (SELECT id, regexp_full_match(id, '[a-z0-9]+_[a-z]+_ch\d{2}_p\d{4}_s\d{3}') AS ok, regexp_extract(id, '^([a-z0-9]+)_([a-z]+)_ch(\d{2})_p(\d{4})_s(\d{3})$', ['b', 'l', 'c', 'p', 's']) AS m FROM r)
SELECT id, CASE WHEN ok THEN m.b END AS book, CASE WHEN ok THEN m.l END AS lang, CASE WHEN ok THEN try_cast(m.c AS INT) END AS chapter, CASE WHEN ok THEN try_cast(m.p AS INT) END AS paragraph, CASE WHEN ok THEN try_cast(m.s AS INT) END AS sentence, nullif(regexp_extract(id, '^([a-z0-9]+_[a-z]+_ch\d{2})_', 1), '') AS scope FROM p""",
    "page_runs": f"""WITH r AS (SELECT DISTINCT book, lang, chapter, page AS row FROM {_B}), i AS (SELECT *, row - row_number() OVER (PARTITION BY book, lang, chapter ORDER BY row) AS i FROM r)
SELECT book, lang, chapter, min(row) AS "first", max(row) AS "last" FROM i GROUP BY book, lang, chapter, i HAVING max(row) - min(row) + 1 >= 2""",
}
