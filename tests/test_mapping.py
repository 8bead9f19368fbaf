from pyspark.sql import functions as F

from glossoloom.operators import mapping as M
from glossoloom.operators import trees


def block(segment, ordinal, *tokens):
    lines = [f"{i + 1}\t{form}\t{lemma}\t{upos}\t_\t_\t{head}\t{deprel}\t_\t_" for i, (form, lemma, upos, head, deprel) in enumerate(tokens)]
    return f"# sent_id = {segment}#b{ordinal:03d}\n# source_segment_id = {segment}\n" + "\n".join(lines), ordinal


def phrase(prep, noun):
    return (prep, prep, "ADP", 2, "case"), (noun, noun, "NOUN", 0, "root")


def test_mapping_records(spark):
    none = ("gone", "gone", "VERB", 0, "root")
    en = [block("e1", 2, *phrase("of", "door")), block("e1", 1, *phrase("with", "wall")), block("e2", 1, *phrase("in", "house")), block("e4", 1, none)]
    blocks = trees.parse_blocks(spark.createDataFrame(en, "text string, ord int"))
    schema = "datapoint_id string, de_prep string, de_surface string, de_lemma string, en_ids array<string>, en_context_ids array<string>, en_confidence double, zh_ids array<string>, zh_context_ids array<string>, zh_confidence double"
    rows = [
        ("near", "in", "im house", "house", ["e1", "e3"], ["e1", "e2", "e3"], 0.95, [], None, None),
        ("anchor", "in", "im Turm", "Turm", ["e1"], [], None, ["z1"], ["z1"], 0.5),
        ("bare", "in", "im Turm", "Turm", ["e4"], None, None, None, None, None),
    ]
    got = {r.datapoint_id: r for r in M.mapping_records(spark.createDataFrame([*rows, rows[0]], schema), {"en": blocks, "zh": blocks.limit(0)}).collect()}
    near, anchor, bare = (got[k] for k in ("near", "anchor", "bare"))
    assert len(got) == 3
    # the best stands in the context only; its id without blocks is counted, and blocks come in document order
    assert (near.en_status, near.en_best_score, near.en_best.segment_id, near.en_best_in_anchor) == ("matched", 8.0, "e2", False)
    assert (near.en_seen, near.en_unresolved, near.en_candidates) == (3, 1, 3)
    assert [(a.sent_id, a.in_anchor) for a in near.en_alternatives] == [("e1#b001", True), ("e1#b002", True)]
    assert (near.zh_status, near.zh_unresolved, near.zh_best, near.zh_reason) == ("unmappable", 0, None, "no_pp_in_target_sentence")
    # no context: the ids are searched
    assert (anchor.en_status, anchor.en_best.sent_id, anchor.en_best_in_anchor, anchor.zh_unresolved) == ("candidate", "e1#b001", True, 1)
    assert (bare.en_seen, bare.en_candidates, bare.en_unresolved, bare.en_reason, bare.en_best_in_anchor) == (1, 0, 0, "no_pp_in_target_sentence", None)


def test_scores_of_given_pairs(spark):
    pairs = [
        ("d1", 1, "in", "im Haus", "Haus", "in", "house", "house", "NOUN", "in the house", 0.95),
        ("d1", 2, "in", "im Haus", "Haus", "of", "door", "door", "NOUN", "of the door", 0.95),
        ("d2", 1, "zu", "zu Merlo", "Merlo", "to", "Merlo", "Merlo", "PROPN", "to Merlo", 0.5),
        ("d2", 2, "zu", "zu Merlo", "Merlo", "with", "him", "he", "PRON", "with him", 0.5),
        ("d3", 1, "von", "vom Turm", "Turm", "against", "wall", "wall", "NOUN", "against the wall", None),
    ]
    df = spark.createDataFrame(pairs, "dp string, cand int, de_prep string, de_surface string, de_lemma string, prep_surface string, head_surface string, head_lemma string, head_upos string, span_text string, confidence double")
    got = M.best_candidates(M.score_candidates(df, "en"), ["dp"]).collect()
    assert {(r.dp, r.cand, r.score, r["rank"], r.status) for r in got} == {("d1", 1, 6.0, 1, "matched"), ("d1", 2, 3.0, 2, "candidate"), ("d2", 1, 12.0, 1, "matched"), ("d2", 2, 2.0, 2, "candidate"), ("d3", 1, 2.0, 1, "candidate")}


def test_phrases_without_a_parse(spark):
    words = spark.sql("SELECT array('He', 'stood', 'at', 'the', 'gate', 'with', 'Merlo', 'in') AS w, CAST(array() AS array<string>) AS e, CAST(NULL AS array<string>) AS n")
    row = words.select(*[M.spaced_phrases(F.col(c), "en").alias(c) for c in "wen"]).collect()[0]
    assert [(p.prep_surface, p.head_lemma, p.head_upos, p.span_text) for p in row.w] == [("at", "gate", "NOUN", "at the gate"), ("with", "merlo", "PROPN", "with Merlo")] and row.e == [] and row.n is None
