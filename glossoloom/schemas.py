"""Schemas of the corpus tables; nothing is ever inferred from data."""

SPAN = "struct<text:string,size:double,flags:int>"
OCR_BLOCK = f"book string, lang string, chapter int, block_id string, page int, block_idx int, text string, bbox array<double>, confidence double, engine string, lines array<struct<spans:array<{SPAN}>>>"
PARAGRAPH = "book string, lang string, chapter int, page int, paragraph int, text string, source_pages array<int>, is_footnote boolean"
SEGMENT = "id string, chapter int, paragraph int, sentence int, text string, source_pages array<int>"
ALIGNMENT = "align_id string, src array<string>, tgt array<string>, src_lang string, tgt_lang string, type string, confidence double, margin double, method string, needs_review boolean, validated boolean"
#: Alignments as older runs wrote them, too.
ALIGNMENT_SUPERSET = ALIGNMENT + ", en array<string>, zh array<string>"
EXTRACTION = "parse_block_id string, source_segment_id string, prep string, det string, noun string, prep_token_id string, det_token_id string, noun_token_id string, pp_token_start string, pp_token_end string, pp_surface string, det_xpos string, det_deprel string, in_filter string"
MANIFEST = "chapter int, form string, parsed_path string, parsed_path_sha256 string, extractor_version string, status string, row_count int, error string"
PP_MAPPING = "mapping_id string, datapoint_id string, chapter int, en_sentence_ids array<string>, zh_sentence_ids array<string>, en_alignment_cardinality string, en_alignment_confidence double"
