"""Closed word lists and vocabularies of the corpus."""

#: Contracted German prepositions and their canonical form.
CONTRACTIONS = {
    "am": "an", "ans": "an", "aufm": "auf", "aufs": "auf", "ausm": "aus", "beim": "bei", "durchs": "durch", "fürm": "für", "fürn": "für", "fürs": "für", "gegens": "gegen", "hinterm": "hinter", "hinters": "hinter", "im": "in", "ins": "in", "ums": "um", "unterm": "unter", "untern": "unter", "unters": "unter", "vom": "von", "vorm": "vor", "vors": "vor", "zum": "zu", "zur": "zu", "überm": "über", "übern": "über", "übers": "über",
}
#: Uncontracted prepositions of the inventory.
PREPOSITIONS = ("an", "auf", "aus", "bei", "durch", "für", "gegen", "hinter", "in", "unter", "von", "zu", "über")
#: Prepositions of both inventories: "um" and "vor" have contractions only.
SHARED_PREPOSITIONS = tuple(sorted(set(CONTRACTIONS.values()) & set(PREPOSITIONS)))
#: The older, shorter list of contractions of the plain-text extractor.
CONTRACTIONS_PLAIN = ("am", "ans", "aufs", "beim", "durchs", "fürs", "hinterm", "hinters", "im", "ins", "ums", "unterm", "unters", "vom", "vorm", "vors", "zum", "zur", "überm", "übers")
DEFINITE_ARTICLES = ("der", "die", "das", "den", "dem", "des")
DETERMINERS = ("der", "die", "das", "den", "dem", "des")
#: English and Chinese forms that can render a German preposition.
PREP_FORMS = {
    "en": {
        "an": ("at", "on", "upon"), "auf": ("on", "onto", "upon"), "bei": ("at", "by", "near", "with"), "durch": ("by", "through", "via"), "für": ("for",), "gegen": ("against", "around", "for"), "hinter": ("after", "behind"), "in": ("at", "in", "inside", "into", "on", "within"), "um": ("about", "around", "at"), "unter": ("among", "below", "beneath", "under"), "von": ("from", "of", "off"), "vor": ("ago", "ahead", "before", "in"), "zu": ("for", "to", "towards"), "über": ("above", "beyond", "over"),
    },
    "zh": {
        "an": ("在", "于"), "auf": ("在", "上"), "bei": ("在", "于"), "durch": ("通过", "穿", "经"), "für": ("为", "给"), "gegen": ("对", "朝", "向"), "hinter": ("后", "在"), "in": ("在", "于", "里", "中"), "um": ("围绕", "为"), "unter": ("下", "在"), "von": ("从", "由", "的"), "vor": ("前", "在"), "zu": ("到", "向", "朝"), "über": ("超", "过", "在"),
    },
}
#: Dependents of a noun that belong to its phrase.
HEAD_MODIFIERS = ("amod", "appos", "compound", "compound:prt", "det", "flat", "flat:name", "nmod:poss", "nummod")
#: Weights of the candidate score, its thresholds, and the confidence above which alignment counts.
SCORE_WEIGHTS = {"prep_semantic_match": 3.0, "proper_name_overlap": 5.0, "lemma_overlap": 2.0, "position_match": 2.0, "align_confidence_bonus": 1.0}
MATCHED, CANDIDATE = 5.0, 2.0
CONFIDENCE_BONUS = {"en": 0.92, "zh": 0.84}
#: Characters that close a sentence, ornaments of a page, and speech verbs of the Chinese merge rule.
TERMINATORS = "。！？；”’》）】\"'.!?;'…)]»«"
ORNAMENTS = "*·•◇◆■□★☆✦✧~〜§"
SPEECH_VERBS = "说问喊叫答嚷吼道"
#: German words that may be stuck to a neighbour in scanned text.
FUNCTION_WORDS = (
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "eines", "kein", "keine", "keinen", "keinem", "keiner", "keines", "in", "an", "auf", "mit", "bei", "zu", "von", "nach", "aus", "vor", "über", "unter", "durch", "ohne", "für", "um", "ab", "seit", "gegen", "trotz", "während", "wegen", "im", "am", "beim", "zum", "zur", "vom", "ins", "ans", "aufs", "übers", "unters", "fürs", "ich", "du", "er", "sie", "es", "wir", "ihr", "mich", "dich", "uns", "euch", "sich", "mein", "dein", "sein", "unser", "euer", "dieser", "diese", "dieses", "jener", "jene", "jenes", "welcher", "welche", "welches", "wer", "was", "und", "oder", "aber", "denn", "sondern", "als", "wenn", "weil", "damit", "obwohl", "dass", "ob", "ist", "war", "sind", "waren", "wird", "werden", "wurde", "wurden", "hat", "hatte", "haben", "hatten", "kann", "könnte", "soll", "muss", "will", "mag", "nicht", "auch", "nur", "schon", "noch", "immer", "wieder", "dann", "dort", "hier", "so", "ja", "nein",
)
ALIGNMENT_TYPES_PATTERN = r"^[0-9]:[0-9]$"
SEGMENT_ID = r"^[a-z0-9]+_[a-z]+_ch\d{2}_p\d{4}_s\d{3}$"
