import math
import random

import pytest

from glossoloom.llm import bitext as B
from glossoloom.llm import scans as N

NOUNS = {"Haus": "house", "Turm": "tower", "Mühle": "mill", "Garten": "garden", "Krug": "jug", "Ring": "ring", "Buch": "book", "Uhr": "clock", "Wald": "forest", "Brief": "letter", "Kerze": "candle", "Stall": "stable"}
VERBS = {"fand": "found", "trug": "carried", "verlor": "lost", "stahl": "stole", "holte": "fetched", "prüfte": "checked"}
NAMES = ["Merlo", "Tavik", "Zirbel", "Dorle", "Hasko", "Sanne"]


def sentence(rng):
    n, m, v, w = rng.choice(list(NOUNS)), rng.choice(list(NOUNS)), rng.choice(list(VERBS)), rng.choice(NAMES)
    k = rng.randint(11, 190)
    return f"{w} {v} den {n} mit {k} Kisten im {m}.", f"{w} {VERBS[v]} the {NOUNS[n]} with {k} crates in the {NOUNS[m]}."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    seg, al, truth = [], [], set()
    for ch in range(1, 9):
        pairs = [sentence(rng) for _ in range(24)]
        ids = lambda lang, i: f"aa_{lang}_ch{ch:02d}_p{i // 5 + 1:04d}_s{i % 5 + 1:03d}"  # noqa: E731, B023
        if ch < 8:
            for i, (d, e) in enumerate(pairs):
                seg += [(ids("de", i), ch, d), (ids("en", i), ch, e)]
                al.append((f"a{ch}{i}", [ids("de", i)], [ids("en", i if rng.random() > 0.08 else (i + 1) % 24)]))
            continue
        english = [[i] for i in range(24)]
        english[5:7] = [[5, 6]]  # joined
        english.pop(10)  # left out
        english.insert(3, english.pop(15))  # moved
        seg += [(ids("de", i), ch, d) for i, (d, _) in enumerate(pairs)]
        for j, group in enumerate(english):
            seg.append((ids("en", j), ch, " ".join(pairs[i][1] for i in group)))
            truth |= {(ids("de", i), ids("en", j)) for i in group}
    return seg, al, truth


def frames(spark, corpus):
    seg, al, _ = corpus
    extra = [("aa_de_ch08_p0099_s001", 8, None), ("aa_en_ch08_p0099_s002", 8, " "), (None, 8, "x"), seg[-1]]
    s = spark.createDataFrame([(*r, "clash") for r in seg + extra], "id string, chapter int, text string, lang string").selectExpr("*", "timestamp'2023-01-01' AS loaded_at")
    a = spark.createDataFrame([(*r, "de", "en") for r in al] + [(None, None, None, None, None), ("x", [None], [], "de", "en")], "align_id string, src array<string>, tgt array<string>, src_lang string, tgt_lang string")
    return s, a


def test_alignment_of_an_open_chapter(spark, corpus):
    s, a = frames(spark, corpus)
    got = B.align_open_chapters(s, a)
    found = {(r.src_id, r.tgt_id) for r in got.collect()}
    truth = corpus[2]
    assert len(found & truth) >= 0.9 * len(truth) and len(found & truth) >= 0.9 * len(found)
    records = B.alignment_records(got).collect()
    assert sum(len(r.src) * len(r.tgt) >= 1 for r in records) == len(records) and any(r.type == "2:1" for r in records)


def test_nothing_to_align(spark, corpus):
    s, a = frames(spark, corpus)
    assert B.align_open_chapters(s.limit(0), a).count() == 0
    assert B.align_open_chapters(s, a.limit(0)).count() >= 0  # no lexicon: only names and numbers are left
    assert B.open_chapters(s, a).collect()[0].chapter == 8


def test_chains_decide_between_equal_sentences():
    said = [["turm", f"wort{i}", f"haus{i}", "krug"] if i % 4 else ["merlo", "fand", "den", "ring"] for i in range(16)]
    heard = [said[1], *said[3:]]  # the first refrain and one sentence are left out
    got = B.align_chapter(said, heard, B.Lexicon())
    assert [(s, t) for s, t, *_ in got] == [(1, 0), *[(i, i - 2) for i in range(3, 16)]] and {k for *_, k in got} == {"main"}
    moved = [*said[:3], *said[9:12], *said[3:9], *said[12:]]
    kinds = {(s, t): k for s, t, _, k in B.align_chapter(said, moved, B.Lexicon())}
    assert {c for c, k in kinds.items() if k == "inversion"} == {(9, 3), (10, 4), (11, 5)} and len(kinds) == 16


def test_cells_off_the_slope_are_noise():
    plane = B.Plane([[f"wort{i}", f"haus{i}"] for i in range(10)], [[f"wort{i}", f"haus{i}"] for i in range(10)], B.Lexicon())
    cells = {(i, i): (0.5, 1.0, 0.7) for i in range(10)} | {(1, 8): (0.7, 1.0, 0.9)}
    assert B.best_chain(plane, cells, (0.0, 0.0))[1] == [(i, i) for i in range(10)]
    assert B.best_chain(plane, {(1, 8): (0.7, 1.0, 0.9)}, (0.0, 0.0))[1] == []
    assert B.align_chapter([[], ["a"]], [[]], B.Lexicon()) == [] and B.align_chapter([], [["a"]], B.Lexicon()) == []


def page(book, p, blocks):
    return [("block", book, "de", 1, f"{book}_pg{p:04d}_b{i:02d}", p, i, t, [p]) for i, t in enumerate(blocks)]


RECORD = "rec_table string, book string, lang string, chapter int, rec_id string, page int, ord int, text string, source_pages array<int>"


@pytest.fixture(scope="module")
def scanned(spark):
    rng = random.Random(5)
    rows = []
    for p in range(10, 60):
        body = [" ".join(sentence(rng)[0] for _ in range(3)) for _ in range(4)]
        head = "Der alte Krug" if p == 10 else ("DER ALTE KRUG" if p % 2 else "Der alte Krug  %d" % (p - 3))
        rows += page("aa", p, [head, *body, "— %d —" % (p - 3) if p % 3 else "1743"])
    bad = {
        "aa_pg0020_b01": "Merlo fand den Kr-\nug im Haus. Tavik vcrlor den Ring mit 30 Kisten im Turm.",
        "aa_pg0021_b02": "Die Nord- und Südmauer stand da. Hasko holte den Brief mit 12 Kistcn im Haus.",
        "aa_pg0022_b03": "Merlo fand den Ring mit 31 Kisten im Gartcn. Sanne verlor die Kcrze mit 40 Kisten im Haus.",
    }
    rows = [(*r[:7], bad.get(r[4], r[7]), r[8]) for r in rows]
    rows += [("block", None, None, None, "n1", None, None, None, None), ("block", "aa", "de", 1, "aa_pg0059_b09", 59, 9, "", [59]), rows[0]]
    return N.scan(spark.createDataFrame(rows, RECORD).distinct()).cache()


def test_defects(spark, scanned):
    found = {(r.rec_id, r.kind) for r in N.defects(scanned, N.correct(scanned)).collect()}
    headers = {i for i, k in found if k == "header"}
    assert headers == {f"aa_pg{p:04d}_b00" for p in range(11, 60)}
    assert {i for i, k in found if k == "page_number"} == {f"aa_pg{p:04d}_b05" for p in range(10, 60) if p % 3}
    assert {i for i, k in found if k == "hyphen"} == {"aa_pg0020_b01"}
    assert {i for i, k in found if k == "misread"} == {"aa_pg0020_b01", "aa_pg0021_b02", "aa_pg0022_b03"}


def test_edits_are_learned(spark):
    rows = [("de", "Krauvhagen", 60), ("de", "Kranvhagen", 1), ("de", "Plaunstein", 30), ("de", "Planustein", 1), ("de", "Braunau", 40), ("de", "Brannau", 2), ("de", "Mühle", 9), ("de", "Mnhle", 1)]
    rows += [("de", "Haus", 50), ("de", "Maus", 4), ("de", "Haut", 30), ("de", "Hut", 30), ("de", "梅罗哈斯科", 40), ("de", "梅罗哈斯料", 1), ("de", "HAUS", 2)]
    links = {}
    for total in (1_000, 10_000_000):  # a plain share would drop the rare names of the large corpus
        counts = spark.createDataFrame([*rows, ("de", "der", total), ("en", "Krauvhagen", total)], "lang string, word string, n bigint")
        links[total] = {(r.word, r.known): round(r.score, 6) for r in N.link_words(counts).collect()}
    assert links[1_000] == links[10_000_000] and set(links[1_000]) == {("Kranvhagen", "Krauvhagen"), ("Planustein", "Plaunstein"), ("Brannau", "Braunau"), ("Maus", "Haus")}
    # u read as n twice, once with its neighbour, against one link of H and M
    assert links[1_000]["Brannau", "Braunau"] > links[1_000]["Maus", "Haus"] + 0.5
    assert links[1_000]["Maus", "Haus"] == pytest.approx(N.PRIOR * math.log10(12.5) - math.log(104 / 102), abs=1e-5)


def test_contexts_reject_words_that_stand_elsewhere(spark):
    rng = random.Random(9)
    names, things = ["Merlo", "Tavik", "Zirbel", "Dorle", "Hasko", "Sanne"], ["Haus", "Turm", "Krug", "Ring", "Wald", "Brief"]
    texts = [[rng.choice(names), "suchte", "den", rng.choice(things), "im", "Garten"] for _ in range(1500)]
    for i, (right, wrong) in enumerate([("Merlo", "Mcrlo"), ("Zirbel", "Zirbcl"), ("Dorle", "Dorlc"), ("Tavik", "Tavlk")]):
        texts[i][0] = wrong
    texts += [["nahm", "Dorlc", "und", "Salz"]] * 6  # a thing, in other company than Dorle
    df = spark.createDataFrame([("block", "aa", "de", 1, f"r{i:05d}", 1, i, t) for i, t in enumerate(texts)], "rec_table string, book string, lang string, chapter int, rec_id string, page int, ord int, words array<string>")
    assert {(r.rec_id, r.word, r.correct) for r in N.correct(df).collect()} == {("r00000", "Mcrlo", "Merlo"), ("r00001", "Zirbcl", "Zirbel"), ("r00003", "Tavlk", "Tavik")}


def test_misread_rare_words_in_a_large_corpus(spark):
    fill = [("block", "aa", "de", 1, f"f{i:05d}", 1, i, ["und"] * 2_000) for i in range(1_000)]
    names = {"Krauvhagen": "Kranvhagen", "Plaustein": "Planstein", "Braunau": "Brannau", "Taubheim": "Tanbheim"}
    said = [("block", "aa", "de", 1, f"{v[0]}{i:03d}", 2, i, ["Merlo", "sah", v if i else w, "im", "Tal"]) for i in range(61) for v, w in names.items()]
    texts = spark.createDataFrame(fill + said, "rec_table string, book string, lang string, chapter int, rec_id string, page int, ord int, words array<string>")
    assert {(r.rec_id, r.word, r.correct) for r in N.correct(texts).collect()} == {(f"{v[0]}000", w, v) for v, w in names.items()}


def test_slices_hold_every_text():
    import pyarrow as pa

    words = pa.array([["a"] * n for n in (3, 0, N.AT_ONCE + 5, 1, 2, N.AT_ONCE, 0, 7)])
    parts = [x.num_rows for x in N.slices(pa.RecordBatch.from_arrays([words], ["words"]), words)]
    assert sum(parts) == 8 and parts == [2, 1, 2, 2, 1] and list(N.slices(pa.RecordBatch.from_arrays([words[:0]], ["words"]), words[:0])) == []


def test_reflow(spark, scanned):
    texts = [r.text for r in N.reflow(scanned, N.correct(scanned)).filter("book = 'aa'").orderBy("paragraph").collect()]
    whole = "\n".join(texts)
    assert "Merlo fand den Krug im Haus. Tavik verlor den Ring mit 30 Kisten im Turm." in whole and "holte den Brief mit 12 Kisten im Haus." in whole and "Nord- und Südmauer" in whole
    assert "KRUG" not in whole and "— " not in whole


def test_empty_tables(spark):
    empty = N.scan(spark.createDataFrame([], RECORD))
    assert N.defects(empty, N.correct(empty)).count() == 0 and N.reflow(empty, N.correct(empty)).count() == 0


def test_paragraph_noise():
    from collections import namedtuple

    Row = namedtuple("Row", "rec_table book lang chapter rec_id page ord clean source_pages counted foreign")
    texts = ["Der rote Turm\nMerlo trug den Krug im - 24 - Haus.", "Sanne fand D E R   R O T E   T U R M den Ring mit 27 Kisten.", "Hasko holte den Br- ief und das Buch.", "Tavik lief Der rote Turm zum Wald.", "Die Wein- oder Obstkammer."]
    rows = [Row("paragraph", "aa", "de", 1, f"p{i}", 27, i, t, [27], [12] if i == 1 else None, None) for i, t in enumerate(texts)]
    got = N.scan_chapter(rows, "paragraph", N.Book([], [N.title_key("Der rote Turm") + "|Der rote Turm"], 3))
    assert [(r.header, r.page_number, r.hyphen) for r in got] == [(False, True, False), (True, False, False), (False, False, True), (True, False, False), (False, False, False)]
    assert got[2].joined == "Hasko holte den Brief und das Buch." and "Tavik lief zum Wald." == got[3].joined
