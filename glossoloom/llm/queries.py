"""Queries of the operators in this subpackage and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import materialize, read_table
from . import bitext, looks, packing, pieces, sampling, scans, sentences, tokens


def _bitext(spark, sf_dir):
    return bitext.align_open_chapters(*[read_table(spark, sf_dir, t) for t in ("segments", "alignments", "anchors")])


def p1_found(spark, sf_dir):
    """Pairs of German and English segments of the open chapters that render the same sentence, wholly or in part."""
    return _bitext(spark, sf_dir).select("src_id", "tgt_id").distinct()


def p1_records(spark, sf_dir):
    """Alignment records of the open chapters with src, tgt, type and confidence."""
    return bitext.alignment_records(_bitext(spark, sf_dir))


def p2_sample(spark, sf_dir):
    """Members of the stable occurrence sample."""
    return sampling.stable_sample(read_table(spark, sf_dir, "occurrences"))


def p3_found(spark, sf_dir):
    """Pairs of different records of a chapter that look the same but differ in characters."""
    records = looks.corpus_records(read_table(spark, sf_dir, "segments"), read_table(spark, sf_dir, "ocr_blocks"))
    return looks.equal_looking_pairs(records, ["rec_table", "book", "lang", "chapter"]).select("rec_table", "id_a", "id_b").distinct()


def p3_forms(spark, sf_dir):
    """Every text of segments and ocr_blocks in its consistent form."""
    records = looks.corpus_records(read_table(spark, sf_dir, "segments"), read_table(spark, sf_dir, "ocr_blocks"))
    return looks.normalize_texts(records.select("rec_table", "rec_id", "text").distinct()).drop("text")


def _scanned(spark, sf_dir):
    return materialize(scans.scan(scans.corpus_records(read_table(spark, sf_dir, "ocr_blocks"), read_table(spark, sf_dir, "paragraphs"))), "p5-scanned")


def p5_found(spark, sf_dir):
    """Records with running headers, page numbers, broken or misread words."""
    scanned = _scanned(spark, sf_dir)
    return scans.defects(scanned, scans.correct(scanned))


def p5_paragraphs(spark, sf_dir):
    """Continuous paragraphs of both tables without the noise."""
    scanned = _scanned(spark, sf_dir)
    return scans.reflow(scanned, scans.correct(scanned))


def _sentence_input(spark, sf_dir):
    return sentences.corpus_texts(read_table(spark, sf_dir, "paragraphs"), read_table(spark, sf_dir, "segments"))


def p7_found(spark, sf_dir):
    """Ends of sentences that another sentence follows in the same text."""
    texts = _sentence_input(spark, sf_dir)
    cut = sentences.sentence_ends(texts, sentences.learn_periods(texts.select("lang", "text")))
    return cut.select("rec_table", "rec_id", F.explode("ends").alias("end_char")).distinct()


def p7_units(spark, sf_dir):
    """Sentence units of every text."""
    texts = _sentence_input(spark, sf_dir)
    units = sentences.sentence_units(texts, sentences.learn_periods(texts.select("lang", "text")))
    return units.select("rec_table", "rec_id", "sentence", "sentence_text")


def p8_ids(spark, sf_dir):
    """Token ids of every document by byte_bpe_50k; empty and null texts have the empty list."""
    return tokens.encode_corpus(read_table(spark, sf_dir, "documents"), tokens.tokenizer_path())


def p8_texts(spark, sf_dir):
    """Every document decoded again from its ids through the id-to-piece table; null texts come back as empty ones."""
    path = tokens.tokenizer_path()
    return tokens.decode_corpus(p8_ids(spark, sf_dir), tokens.piece_table(spark, path))


def p9_bins(spark, sf_dir):
    """Every document in a container of 512, 1024 or 2048 tokens."""
    sizes = tokens.count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokens.tokenizer_path())
    return packing.pack(materialize(sizes, "p9-sizes"))


def p10_pieces(spark, sf_dir):
    """Pieces of at most 512 tokens of every document, with up to 64 tokens of overlap."""
    return pieces.split_texts(read_table(spark, sf_dir, "documents"), tokens.tokenizer_path())


def p10_texts(spark, sf_dir):
    """Every document put together again from the fresh parts of its pieces."""
    fresh = F.expr("substring(text, fresh_start - start + 1)")
    parts = p10_pieces(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", fresh.alias("t")))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda x: F.coalesce(x["t"], F.lit(""))), "").alias("text"))


QUERIES = {
    "p1_found": p1_found,
    "p1_records": p1_records,
    "p2_sample": p2_sample,
    "p3_found": p3_found,
    "p3_forms": p3_forms,
    "p5_found": p5_found,
    "p5_paragraphs": p5_paragraphs,
    "p7_found": p7_found,
    "p7_units": p7_units,
    "p8_ids": p8_ids,
    "p8_texts": p8_texts,
    "p9_bins": p9_bins,
    "p10_pieces": p10_pieces,
    "p10_texts": p10_texts,
}

ORACLE = {
    "p8_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p10_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p2_sample": f"""
SELECT DISTINCT datapoint_id FROM occurrences
WHERE substr(sha256('{sampling.SALT}|' || datapoint_id), 1, {sampling.DIGITS}) <
      CASE form WHEN 'contracted' THEN '{sampling.threshold(sampling.RATES["contracted"])}'
                WHEN 'uncontracted' THEN '{sampling.threshold(sampling.RATES["uncontracted"])}'
                ELSE '{sampling.threshold(sampling.OTHER_RATE)}' END
""",
}
