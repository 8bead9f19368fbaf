import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossoloom.llm import packing as P
from glossoloom.llm import pieces as C
from glossoloom.llm import tokens as K

PATH = K.tokenizer_path()
TEXTS = ["", " ", "Das  Haus\n\n steht 12-mal.", "它's 好。“是”　", "a" * 5000, "\x85 \xa0x y​", "don't <|endoftext|> 😀é", "\t\r\n", "Ünïcödé é ١٢٣"]


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(K.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0, "w") for i, t in enumerate(texts)], "doc_id long, text string, ids int, _words string")


@pytest.mark.parametrize("table_size", [K.TABLE_SIZE, 4])
def test_equals_another_library(spark, hf, table_size):
    texts = [*TEXTS, *TEXTS, None, "häufig " * 300]
    rows = K.encode_corpus(frame(spark, texts), PATH, table_size=table_size).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: hf(t) if t else [] for i, t in enumerate(texts)}


def test_empty_and_repeated(spark):
    df = frame(spark, ["x y", None])
    assert K.encode_corpus(df.limit(0), PATH).count() == 0 and K.encode_corpus(df.union(df), PATH).count() == 4
    assert sorted(r.n_tokens for r in K.count_tokens(df, PATH).collect()) == [0, 2]
    assert K.count_tokens(df, PATH).columns == ["doc_id", "ids", "_words", "n_tokens"]


def test_decode_round_trip(spark):
    df = frame(spark, TEXTS)
    got = K.decode_corpus(K.encode_corpus(df, PATH), K.piece_table(spark, PATH)).collect()
    assert {r.doc_id: r.text for r in got} == dict(enumerate(TEXTS))
    null = spark.sql("SELECT 1L AS doc_id, CAST(NULL AS array<int>) AS ids")
    assert K.decode_corpus(null, K.piece_table(spark, PATH)).collect()[0].text is None


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plans_hold_every_item_once(histogram):
    plan = P.plan_bins(histogram, (10, 20, 40))
    placed = {}
    for p in plan:
        assert p.bins > 0 and sum(s * k for s, k in p.items) <= p.capacity and p.capacity in (10, 20, 40)
        for s, k in p.items:
            placed[s] = placed.get(s, 0) + k * p.bins
    assert placed == histogram
    total = sum(s * n for s, n in histogram.items())
    assert sum(p.capacity * p.bins for p in plan) <= 2 * total + 40  # best fit wastes less than half


def test_many_small_items_leave_little_room():
    rng = np.random.default_rng(1)
    sizes = np.minimum(2048, rng.lognormal(5.5, 1, 20_000).astype(int) + 1)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
    plan = P.plan_bins(histogram)
    assert sum(s * n for s, n in histogram.items()) / sum(p.capacity * p.bins for p in plan) > 0.99


def test_costs_decide_between_capacities():
    assert {p.capacity for p in P.plan_bins({10: 7}, (10, 40), 2.0)} == {10}


def test_pack(spark):
    sizes = [5, 5, 5, 7, 20, 0, None, 93, 12, 5]
    items = spark.createDataFrame([(i // 2, n, "b") for i, n in enumerate(sizes)], "doc_id long, n_tokens long, bin_id string")
    rows = P.pack(items, capacities=(10, 40)).toPandas()
    assert rows.bin_id.isna().sum() == 2 and rows["size"].sum() == sum(n or 0 for n in sizes) and len(rows) == 12
    bins = rows[rows.bin_id.notna()].groupby("bin_id").agg(n=("size", "sum"), c=("capacity", "first"))
    assert (bins.n <= bins.c).all()
    cut = rows[(rows.doc_id == 3) & (rows["size"] > 0)].sort_values("start")
    assert cut["size"].sum() == 93 and cut.start.tolist() == [0, 40, 80]
    assert P.pack(items.limit(0), capacities=(10, 40)).count() == 0
    again = P.pack(items.repartition(3), capacities=(10, 40)).toPandas()
    key = ["doc_id", "piece", "size", "bin_id"]
    assert rows.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))


def counter_of(text):
    import regex

    words = regex.findall(K.PYTHON_PATTERN, text)
    encode = lambda s: len(K.encode_word(PATH, s))
    chars, toks = [0], [0]
    for w in words:
        chars.append(chars[-1] + len(w))
        toks.append(toks[-1] + encode(w))
    assert chars[-1] == len(text)
    return C.Counter(text, chars, toks, encode)


def pieces_of(text, limit, overlap):
    return C.cut(text, counter_of(text), limit, overlap)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 'sreZ1.\n\n \t好é", max_size=60), st.data())
def test_counts_of_spans_are_exact(text, data):
    count, encoding = counter_of(text), K.load_encoding(PATH)
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    assert count(a, b) == len(encoding.encode_ordinary(text[a:b]))


def test_tree_of_nested_headings_and_lists():
    text = "Vorwort steht hier.\n\n# A\nEins.\n\n## A1\n- x\n  - y\n    mehr\n  - z\n- w\n## A2\nZwei.\n# B\n### B1\nDrei.\n\na\tb\nc\td\n\fSeite\n"
    said = lambda node: text[node.start : node.end]
    first, page = C.parse(text).children
    assert said(page) == "Seite\n" and page.level == first.level == C.PAGE
    body = text[: page.start]
    intro, a, b = C.parse(body).children
    assert [x.level for x in (a, b)] == [C.SECTION] * 2 and said(a).startswith("# A\n") and said(a).endswith("Zwei.\n")
    assert [said(x).split("\n")[0] for x in a.children] == ["# A", "Eins.", "## A1", "## A2"] and [said(x).split("\n")[0] for x in b.children] == ["# B", "### B1"]
    heading, x, w = a.children[2].children
    assert said(x) == "- x\n  - y\n    mehr\n  - z\n" and said(w) == "- w\n" and [said(i) for i in x.children[1:]] == ["  - y\n    mehr\n", "  - z\n"]

    def tiles(node):
        assert not node.children or [node.start, *[c.end for c in node.children]] == [*[c.start for c in node.children], node.end]
        for c in node.children:
            tiles(c)

    tiles(C.parse(text))


def test_siblings_are_merged_and_only_large_nodes_opened():
    section = lambda h, n: f"{h} Titel\n" + "Ein Satz steht hier. " * n + "\n\n"
    text = section("#", 3) + section("##", 3) + section("##", 3) + section("#", 30) + section("#", 3)
    starts = [text[s:].split("\n")[0] for s, _, _ in pieces_of(text, 80, 0)]
    assert starts[:3] == ["# Titel", "## Titel", "# Titel"] and len(starts) >= 5
    assert all(text[:e].endswith("\n\n") or text[:e].endswith(".") for _, e, _ in pieces_of(text, 80, 0))
    deep = "".join("  " * i + f"- punkt {i}\n" for i in range(300))
    assert [f for *_, f in pieces_of(deep, 40, 0)][0] == 0 and sum(e - f for _, e, f in pieces_of(deep, 40, 0)) == len(deep)


ODD = st.text(alphabet="ab Zé.\n-。好，“”\f\t1é", max_size=400)


@settings(max_examples=120, deadline=None)
@given(ODD, st.integers(8, 30), st.integers(0, 6))
def test_pieces_cover_and_fit(text, limit, overlap):
    encoding, at = K.load_encoding(PATH), 0
    for k, (start, end, fresh) in enumerate(pieces_of(text, limit, overlap)):
        assert fresh == at and start <= fresh and (end > fresh or not text) and (k or start == 0)
        assert len(encoding.encode_ordinary(text[start:end])) <= limit
        assert counter_of(text)(start, end) == len(encoding.encode_ordinary(text[start:end]))
        at = end
    assert at == len(text)


def test_natural_boundaries():
    text = "Titel\n\n" + "Ein Satz steht hier. Noch ein Satz folgt ihm.\n\n" * 30
    cuts = [e for _, e, _ in pieces_of(text, 60, 0)][:-1]
    assert all(text[:e].endswith("\n\n") for e in cuts)
    text = "Ein Satz steht hier. " * 40
    assert all(text[:e].endswith(".") for _, e, _ in pieces_of(text, 50, 0)[:-1])
    text = "好的句子在这里。" * 60
    assert all(text[:e].endswith("。") for _, e, _ in pieces_of(text, 50, 0)[:-1])


def test_overlap_is_used():
    text = "wort " * 400
    got = pieces_of(text, 40, 8)
    assert all(0 < f - s for s, _, f in got[1:]) and all(len(K.load_encoding(PATH).encode_ordinary(text[s:f])) <= 8 for s, _, f in got[1:])


def test_split_texts(spark):
    long = "x" * 30_000 + " Ende."
    rows = C.split_texts(frame(spark, [None, "", "kurz", long, long]), PATH, limit=64, overlap=8).toPandas()
    assert rows[rows.doc_id == 0].text.isna().all() and rows[rows.doc_id <= 2].piece.eq(0).all()
    for d in (3, 4):
        mine = rows[rows.doc_id == d].sort_values("piece")
        assert mine.n_tokens.tolist() == [len(K.load_encoding(PATH).encode_ordinary(t)) for t in mine.text]
        assert mine.n_tokens.max() <= 64 and "".join(t[f - s :] for t, s, f in zip(mine.text, mine.start, mine.fresh_start)) == long
    assert C.split_texts(frame(spark, [None]).limit(0), PATH).count() == 0
