import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glossoloom.operators import align as A


def angles(*degrees):
    r = np.radians(degrees)
    return np.stack([np.cos(r), np.sin(r)], 1)


def brute(sims, s):
    """The best total over all monotone paths, by plain recursion on means."""
    n, m = sims.shape
    window = lambda i, j: abs(j - int(round(i * m / n))) <= int(max(1, s.band * m))
    best = {(0, 0): 0.0}
    for i in range(n + 1):
        for j in range(m + 1):
            if (i, j) == (0, 0) or not window(i, j):
                continue
            options = [best[p] - s.gap for p in ((i - 1, j), (i, j - 1)) if p in best]
            for a in range(1, s.max_group + 1):
                for b in range(1, s.max_group + 2 - a):
                    if (i - a, j - b) in best and b <= s.max_group and (mean := sims[i - a : i, j - b : j].mean()) >= A.FLOOR:
                        options.append(best[i - a, j - b] + mean - s.multi * (a + b - 2))
            if options:
                best[i, j] = max(options)
    return best.get((n, m))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(1, 7), st.integers(0, 10_000))
def test_total_equals_brute_force_and_records_partition(n, m, seed):
    sims = np.random.default_rng(seed).uniform(-0.2, 1, (n, m))
    s = A.AlignSettings(band=1.0)
    p = A.Program(sims, s, None, False)
    assert p.best[n, m] == pytest.approx(brute(sims, s))
    records = p.records()
    assert [i for r in records for i in r[0]] == list(range(n)) and [j for r in records for j in r[1]] == list(range(m))
    assert all(r[3] is None or r[3] > -1e-9 for r in records) and all(r[2] >= 0 for r in records)


def test_one_to_two_by_hand():
    src, tgt = angles(0), angles(np.degrees(np.arccos(0.9)), -np.degrees(np.arccos(0.75)))
    [(s, t, score, margin)] = A.align_vectors(src, tgt)
    assert (s, t) == ([0], [0, 1]) and score == pytest.approx(0.805) and margin == pytest.approx(0.005)


def test_empty_sides_and_unknown_mode():
    assert A.align_vectors(np.zeros((0, 2)), angles(1)) == []
    with pytest.raises(ValueError):
        A.align_vectors(angles(1), angles(1), A.AlignSettings(mode="other"))


def test_walls_hold():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(12, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = A.align_two_pass(v, np.delete(v, 5, 0), A.AlignSettings(two_pass=True))
    pairs = {(r[0][0], r[1][0]) for r in got if len(r[0]) == len(r[1]) == 1}
    assert {(i, i - (i > 5)) for i in range(12) if i not in (4, 5, 6)} <= pairs
    assert [i for r in got for i in r[0]] == list(range(12)) and [j for r in got for j in r[1]] == list(range(11))


def test_ratio_by_hand():
    sims = np.array([[0.8, 0.2], [0.4, 0.6]])
    r = 0.8 / ((0.8 + 0.8) / 2)
    assert A.ratio(sims, 1)[0, 0] == pytest.approx(r / (1 + r))


def test_scopes(spark):
    rows = [("a", i, f"s{i}", "text", [float(x) for x in v]) for i, v in enumerate(angles(0, 40, 80))]
    src = spark.createDataFrame([*rows, ("only", 0, "x", None, [1.0, 0.0])], "scope string, pos int, id string, text string, vector array<double>")
    got = A.numbered(A.align_scopes(src, src.filter("scope = 'a'"), A.AlignSettings())).orderBy("ord").collect()
    assert [(r.align_id, r.src, r.tgt, r.type) for r in got] == [(f"a{i + 1:04d}", [f"s{i}"], [f"s{i}"], "1:1") for i in range(3)]
    assert A.align_scopes(src.limit(0), src.limit(0)).count() == 0


def test_scopes_use_anchors(spark):
    schema = "scope string, pos int, id string, text string, vector array<double>, anchors array<string>"
    v = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    src = spark.createDataFrame([("a", i, f"s{i}", "text", v[i], [["Krug"], ["1743"], None][i]) for i in range(3)], schema)
    # the first sentence is left out on the other side, which only the number shows
    tgt = spark.createDataFrame([("a", i, f"t{i}", "text", v[i + 1], [["1743"], None][i]) for i in range(2)], schema)
    run = lambda a, b: {tuple(r.src): tuple(r.tgt) for r in A.align_scopes(a, b, A.AlignSettings(band=1.0, max_group=1, two_pass=True)).collect()}
    assert run(src, tgt) == {("s0",): (), ("s1",): ("t0",), ("s2",): ("t1",)}
    assert A.align_scopes(src, tgt.drop("anchors")).count() == A.align_scopes(src.drop("anchors"), tgt).count()


def test_bonus_matrix_is_the_join(spark):
    src, tgt = [{"Krug", "12"}, set(), {"Krug"}, {"77"}], [{"12"}, {"Krug", "12", "77"}, {"Ring"}]
    df = lambda side, name: spark.createDataFrame([("a", f"{name}{i}", sorted(x)) for i, x in enumerate(side)], "scope string, id string, anchors array<string>")
    want = {(r.src_id, r.tgt_id): r.bonus for r in A.anchor_bonus(df(src, "s"), df(tgt, "t")).collect()}
    got = A.bonus_matrix(src, tgt, A.PRODUCTION)
    assert {(f"s{i}", f"t{j}"): pytest.approx(got[i, j]) for i, j in zip(*got.nonzero())} == want


def test_two_pass_align_takes_anchors(spark, tmp_path):
    from glossoloom.plans import corpus

    texts = {"de": ["Merlo lief davon.", "Merlo sah 1743 hinaus."], "en": ["Out of it, in 1743, looked someone."]}
    rows = [(f"aa_{lang}_ch01_p0001_s{i + 1:03d}", 1, 1, i + 1, t) for lang, side in texts.items() for i, t in enumerate(side)]
    spark.createDataFrame(rows, "id string, chapter int, paragraph int, sentence int, text string").selectExpr("*", "timestamp'2023-01-01' AS loaded_at", "cast(null AS timestamp) AS deleted_at").write.parquet(f"{tmp_path}/segments.parquet")
    spark.createDataFrame([("Merlo", "Merlo", None, "name")], "de_form string, en_form string, zh_form string, kind string").write.parquet(f"{tmp_path}/anchors.parquet")
    seen = []
    original = A.align_scopes
    try:
        A.align_scopes = lambda a, b, *rest: seen.extend(({r.id[-4:]: list(r.anchors) for r in a.collect()}, [list(r.anchors) for r in b.collect()])) or original(a, b, *rest)
        corpus.two_pass_align(spark, str(tmp_path)).collect()
    finally:
        A.align_scopes = original
    assert seen == [{"s001": ["Merlo"], "s002": ["1743", "Merlo"]}, [["1743"]]]


def test_encoder_is_deterministic_and_unit():
    e = A.HashEncoder()
    v = e.encode(["ein Haus", "ein Haus", "", "other"])
    assert np.allclose(v[0], v[1]) and np.allclose(np.linalg.norm(v, axis=1), 1)


def test_cache(spark):
    df = spark.createDataFrame([("de", "s1", 2, "b", "y"), ("de", "s1", 1, "a", None)], "lang string, scope string, pos int, id string, text string")
    key = A.cache_key(df, "m")
    assert A.cache_misses(key, key).count() == 0 and A.cache_misses(key, A.cache_key(df, "other")).count() == 1
    assert A.cache_key(df.orderBy("pos"), "m").collect() == key.collect()
