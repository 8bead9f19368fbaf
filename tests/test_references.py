import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from glossoloom.operators.references import corpus_orphans, orphan_references
from glossoloom.operators.skew import skew_safe_left_join

REFS = "a int, b int, at int, loaded string"
TARGETS = "x int, y int, loaded int, deleted int"


def brute(refs, targets, match):
    """Rows whose key has no partner, by comparing with every target."""
    out = []
    for r in refs:
        key = r[:2]
        nulls = sum(k is None for k in key)
        if nulls == 2 or match == "simple" and nulls:
            continue
        if match == "full" and nulls:
            out.append(r)
            continue
        at = 10**9 if r[2] is None else r[2]
        if not any(all(k is None or k == t for k, t in zip(key, row)) and row[2] is not None and row[2] <= at and (row[3] is None or row[3] > at) for row in targets):
            out.append(r)
    return sorted(out, key=repr)


small = st.one_of(st.none(), st.integers(0, 2))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(small, small, small, st.sampled_from(["u", "v"])), max_size=12), st.lists(st.tuples(small, small, small, small), max_size=8))
@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_equals_brute_force(spark, match, refs, targets):
    got = orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS), [("a", "x"), ("b", "y")], match=match, period="at", loaded="loaded", deleted="deleted")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(refs, targets, match)


def test_hot_key_keeps_every_row(spark):
    left = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id) END AS k", "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v int")
    got = skew_safe_left_join(left, right, ["k"])
    assert got.count() == 5000 and got.filter("v = 1").count() == 1667 and got.filter("v = 2").count() == 1


def test_corpus_edge_cases(spark):
    ts = "timestamp'2023-05-03'"
    seg = spark.sql(f"SELECT 's1' AS id, {ts} AS loaded_at, timestamp'2023-06-01' AS deleted_at, 'x' AS target_id, 1 AS key UNION ALL SELECT NULL, NULL, NULL, NULL, 2")
    al = spark.sql(f"SELECT 'a1' AS align_id, array('s1', NULL, 'nope') AS src, CAST(NULL AS array<string>) AS tgt, {ts} AS loaded_at UNION ALL SELECT 'a1', array('s1', 'nope'), array(), {ts} UNION ALL SELECT 'a2', array('s1'), array(), timestamp'2023-06-30'")
    oc = spark.sql(f"SELECT 'd1' AS datapoint_id, CAST(NULL AS string) AS source_segment_id, {ts} AS loaded_at, CAST(NULL AS timestamp) AS deleted_at")
    pm = spark.sql(f"SELECT 'm1' AS mapping_id, 'd1' AS datapoint_id, timestamp'2023-04-30' AS loaded_at UNION ALL SELECT NULL, 'd1', {ts}")
    got = sorted(tuple(r) for r in corpus_orphans(seg, al, oc, pm).collect())
    assert got == [("alignments", "src", "a1", "nope", "2023-05"), ("alignments", "src", "a2", "s1", "2023-06"), ("pp_mappings", "datapoint_id", "m1", "d1", "2023-04")]
    assert corpus_orphans(seg.limit(0), al.limit(0), oc.limit(0), pm.limit(0)).count() == 0
    assert corpus_orphans(seg.limit(0), al, oc, pm).count() == 4
