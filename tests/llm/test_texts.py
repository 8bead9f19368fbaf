import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossoloom.llm import looks as L
from glossoloom.llm import sampling as S
from glossoloom.llm import sentences as T

ALPHABET = "aouAZ.,\n -\u00eb\u0301\u00e9\u00ad\u200b\u00a0\u3000\uff47\uff11\uff0c\u0430\u0415\u03bf\u2f26\ufb01\ufeff\u597d\u0308"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40))
def test_form_is_stable_and_equals_brute_force(text):
    form = L.same_look(text)
    assert L.same_look(form) == form and unicodedata.is_normalized("NFC", form)
    kept = text.replace("\xad\n", "\ue010\n")  # the hyphen at a line end shows
    table = L.mapping()
    brute = unicodedata.normalize("NFC", "".join(table.get(c, c) for c in unicodedata.normalize("NFD", kept))).replace("\ue010", "\xad")
    assert form == brute


@pytest.mark.parametrize("a, b, same", [("Κirche", "Kirche", True), ("Ｔａｇ １", "Tag 1", True), ("ä", "ä", True), ("a​̈", "ä", True), ("auf dem", "auf dem", True), ("⼦", "子", True), ("ﬁnden", "finden", True), ("ä", "a", False), ("Haus", "haus", False), ("a b", "a\nb", False), ("“a”", '"a"', False), ("，", ",", False)])
def test_what_looks_the_same(a, b, same):
    assert (L.same_look(a) == L.same_look(b)) is same


def test_pairs(spark):
    rows = [("t", "1", "Κrug"), ("t", "1", "Κrug"), ("t", "2", "Krug"), ("t", "3", "Krug"), ("t", "4", "Kr​ug"), ("u", "5", "Κrug"), ("t", "6", None), ("t", "7", ""), (None, "8", "Κ"), (None, "9", "K"), ("t", "2", "Κrug"), ("t", "10", "x" * 100_000), ("t", "11", "​" + "x" * 100_000)]
    df = spark.createDataFrame([(*r, "id") for r in rows], "rec_table string, rec_id string, text string, id_a string")
    got = sorted(((r.rec_table or "", r.id_a, r.id_b) for r in L.equal_looking_pairs(df, ["rec_table"]).collect()))
    brute = sorted({(a[0] or "", *sorted((a[1], b[1]))) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and a[2] and b[2] and a[2] != b[2] and L.same_look(a[2]) == L.same_look(b[2])})
    assert got == brute and len(got) > 5
    assert L.equal_looking_pairs(df.limit(0), ["rec_table"]).count() == 0


def test_malformed_ids(spark):
    segments = spark.createDataFrame([("bad-id", "Κrug"), ("xx_de_chX_p0001_s001", "Krug"), ("a_de_ch99999999999_p1_s1", "Krug"), (None, "Krug"), ("a_de_ch01_p0001_s001", "Krug"), ("a_de_ch01_p0001_s002", "Κrug")], "id string, text string")
    blocks = spark.createDataFrame([], "book string, lang string, chapter int, block_id string, text string")
    got = L.equal_looking_pairs(L.corpus_records(segments, blocks), ["rec_table", "book", "lang", "chapter"]).collect()
    assert {(r.id_a, r.id_b) for r in got} == {("bad-id", "xx_de_chX_p0001_s001"), ("a_de_ch01_p0001_s001", "a_de_ch01_p0001_s002")}


def test_mapping_is_checked_and_read_longest_first():
    table = {}
    L.add_entry(table, "а", "a")
    with pytest.raises(L.MappingConflict):
        L.add_entry(table, "а", "o")
    read = L.Transducer({"a": "1", "ab": "2", "abcd": "3"}).read
    assert read("abcab") == [("ab", "2"), ("c", "c"), ("ab", "2")] and read("abcd") == [("abcd", "3")] and read("") == []
    assert L.same_look("а\u0308") == "ä" and L.same_look("\U0001d670ＢС") == "ABC" and L.same_look("ѐ\u0323") == unicodedata.normalize("NFC", "è\u0323")


def test_sample_keeps_its_members(spark):
    df = spark.range(3000).selectExpr("concat('dp', id) AS datapoint_id", "CASE WHEN id % 3 = 0 THEN 'contracted' WHEN id % 3 = 1 THEN 'uncontracted' END AS form", "id AS loaded_at", "'x' AS stratum")
    small = df.filter("loaded_at < 1500")
    ids = lambda d, **k: {r.datapoint_id for r in S.stable_sample(d, **k).collect()}
    one, two = ids(small), ids(df.union(df).repartition(7))
    assert one <= two and one == ids(small.repartition(1)) and 0.08 < len(two) / 3000 < 0.2
    changed = small.selectExpr("datapoint_id", "'other' AS form", "loaded_at", "stratum")
    assert one <= ids(small.union(changed))
    assert two <= ids(df, rates=S.raise_thresholds(S.RATES, {"contracted": 0.5, "uncontracted": 0.01}))
    nulls = spark.sql("SELECT CAST(NULL AS string) AS datapoint_id, 'contracted' AS form UNION ALL SELECT '', NULL")
    assert ids(nulls, rates={}, other_rate=1.0) == {""} and ids(df.limit(0)) == set() and ids(small, rates={}, other_rate=0.0) == set()


def test_recorded_rates_only_rise(spark, tmp_path):
    store = f"{tmp_path}/rates"
    assert S.recorded_rates(spark, store, {"a": 0.2}) == {"a": 0.2}
    assert S.recorded_rates(spark, store, {"a": 0.1, "b": 0.3}) == {"a": 0.2, "b": 0.3}
    assert S.recorded_rates(spark, store, {"a": 0.4}) == {"a": 0.4, "b": 0.3} == S.recorded_rates(spark, store, {})
    assert spark.read.parquet(store).count() == 3 and S.RATES == {"contracted": 0.2, "uncontracted": 0.1}


def test_thresholds():
    assert S.threshold(0) == "0" * 13 and S.threshold(1) > "f" * 13 and S.threshold(0.5) == "8" + "0" * 12
    assert S.raise_thresholds({"a": 0.5}, {"a": 0.2, "b": 0.1}) == {"a": 0.5, "b": 0.1}


DE = T.Periods(inner={"dr", "nr", "st", "ca", "prof"}, final={"usw"}, starters={"der"})
EN = T.Periods(inner={"mr", "dr", "e.g"}, final={"etc", "p.m"}, starters={"the"}, speech={"cried", "asked"})
ZH = T.Periods(speech={"问道", "说道"})


@pytest.mark.parametrize("lang, sentences", [
    ("de", ["Er kam.", "Sie ging."]),
    ("de", ["Herr Dr. Merlo zahlte 1,43 Taler.", "Nr. 7 lag da.", "Am 13. Januar fand er es."]),
    ("de", ["Er trug Brot, Salz usw. in das Haus.", "Er trug Brot usw.", "Der Müller kam."]),
    ("de", ["„Komm herein.", "Die Tür ist offen“, sagte Merlo.", "Er ging."]),
    ("de", ["„Halt!“", "Immeke lief zum Hügel.", "Er las „Wohin so spät?“ im Haus."]),
    ("de", ["Tavik rief: »Nimm den Krug!«", "»Wer ist da?«, fragte sie."]),
    ("de", ["(Niemand sah den Ring.)", "Zirbel (welch ein Schreck!) verlor ihn.", "Das war es?!", "Er wartete … dann kam sie."]),
    ("en", ["“Stop!” Velten cried through the hall.", "“Stop!”", "Velten ran away.", "“Who is there?” asked the cook."]),
    ("en", ["At 5.15 p.m. Sanne went home.", "Ulfram left at 4 p.m.", "The cook slept."]),
    ("zh", ["“进来吧。", "门开着。”", "“谁在那里？”多尔勒问道。", "梅罗说道：“拿走鼓！”", "他走了。"]),
    ("zh", ["他读着《书去哪儿？》这本书。", "奎里娜大喊! ", "（没有人看见。）", "找到了第25.6号水壶. ", "“好吧，”他说道，“我去。”", "完。"]),
])
def test_boundaries(lang, sentences):
    join = "" if lang == "zh" else " "
    text = join.join(sentences)
    ends, at = [], 0
    for s in sentences[:-1]:
        ends.append(at + len(s.rstrip()))
        at += len(s) + len(join)
    assert T.boundaries(text, lang, {"de": DE, "en": EN, "zh": ZH}[lang]) == ends


def test_heading_and_invisible_characters():
    assert T.boundaries("Der alte Turm\nEr kam.​ Sie ging.", "de", DE) == [13, 21]
    assert T.boundaries("Er kam bes-\nonders spät.", "de", DE) == []


def learned(spark, rows):
    facts = T.learn_periods(spark.createDataFrame(rows, "lang string, text string")).collect()
    return {lang: T.periods_of([f for f in facts if f.lang == lang]) for lang in {f.lang for f in facts}}


def test_learning(spark):
    names, verbs = ["Merlo", "Tavik", "Zirbel", "Dorle", "Hasko", "Sanne"], ["kam", "ging", "schlief", "sang"]
    rows = []
    for i in range(600):
        a, b, v = names[i % 6], names[(i * 5 + 1) % 6], verbs[i % 4]
        rows.append(("de", f"Herr Dr. {a} {v} heute. Bald {v} {b} nach Hause. Der Hund {v} dort mit ca. {i} Leuten."))
    p = learned(spark, [*rows, ("de", None), (None, "Dr. x")])["de"]
    assert {"dr", "ca"} <= p.inner | p.final and not {"heute", "hause"} & (p.inner | p.final) and "bald" in p.starters
    assert learned(spark, []) == {}


def test_words_of_who_speaks_are_learned(spark):
    rows = []
    for i in range(200):
        rows += [("en", f"“Take it,” said the cook. “Who is there {i}?” asked Merlo. “Stop!” Tavik ran away. The cook said nothing. Near the house the cook met the other cook and the cook of the inn."), ("zh", f"“好，”梅罗说道。“谁？”多尔勒喊道。他走了。“{i}，”她喊道。")]
    facts = learned(spark, rows)
    assert {"said", "asked"} <= facts["en"].speech and not {"ran", "the", "cook"} & facts["en"].speech
    assert {"说道", "喊道"} <= facts["zh"].speech and "走了" not in facts["zh"].speech
    assert T.boundaries("“Stop!” Merlo asked. He ran.", "en", facts["en"]) == [20] and T.boundaries("“Stop!” Merlo ran. He fell.", "en", facts["en"]) == [7, 18]


def test_collocations_and_starters_decide(spark):
    final = T.Periods(final={"st"}, starters={"bald"})
    text = "Er ging nach St. Trell und weiter."
    assert T.boundaries(text, "de", final) == [16]
    assert T.boundaries(text, "de", T.Periods(final={"st"}, collocations={("st", "trell")})) == []
    assert T.boundaries("Es war der 12. Bald kam er.", "de", final) == [14] and T.boundaries("Es war der 12. Mai und kalt.", "de", final) == []


def test_facts_are_those_of_the_words_of_a_text(spark):
    rows = [("a", "de", "Herr Dr. Merlo kam. Er ging."), ("b", "en", "He met Dr. Merlo. He left."), ("c", "de", "x" * 200 + " kam. " + "Und er blieb lange dort, " * 2000 + "bis Dr. Merlo ging. Ende."), ("a", "de", "Herr Dr. Merlo kam. Er ging.")]
    df = spark.createDataFrame([(*r, [9], "w") for r in rows], "id string, lang string, text string, ends array<int>, row string")
    got = T.sentence_ends(df, {"de": T.Periods(inner={"dr"})})
    assert got.columns == ["id", "lang", "text", "row", "ends"] and sorted((r.id, len(r.ends)) for r in got.collect()) == [("a", 1), ("a", 1), ("b", 2), ("c", 2)]


def test_units(spark):
    rows = [("a", "de", "Er kam. Sie ging."), ("b", None, "Er kam. Sie ging."), ("c", "de", None), ("d", "de", " \n"), ("e", "de", "Er kam. " * 20_000), ("a", "de", "Er kam. Sie ging.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, lang string, text string, ends int")
    got = T.sentence_units(df, {"de": DE}).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {"a": 4, "b": 2, "e": 20_000}
    assert T.sentence_ends(df.limit(0), {}).count() == 0
