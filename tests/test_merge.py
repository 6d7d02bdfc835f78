import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridhour.operators import dedupe, joins, merge

SCHEMA = "k int, a double, b double"
OLD = [(1, 1.0, None), (2, 2.0, 20.0), (3, None, 30.0)]
NEW = [(2, 2.005, None), (3, 3.0, 31.0), (4, 4.0, None)]


def run(spark, policy, tol=0.0, old=OLD, new=NEW, **kw):
    out = merge.merge_frames(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA), ["k"], policy, tol, **kw)
    return {r.k: (r.a, r.b) for r in out.collect()}


@pytest.mark.parametrize(
    "policy, expected",
    [
        (merge.INSERT_IGNORE, {2: (2.0, 20.0), 3: (None, 30.0), 4: (4.0, None)}),
        (merge.FILL_NULL, {2: (2.0, 20.0), 3: (3.0, 30.0), 4: (4.0, None)}),
        (merge.OVERWRITE_DIFFERENT, {2: (2.0, 20.0), 3: (3.0, 31.0), 4: (4.0, None)}),
        (merge.UPSERT, {2: (2.005, None), 3: (3.0, 31.0), 4: (4.0, None)}),
        (merge.PREFER_FRESH, {2: (2.005, 20.0), 3: (3.0, 31.0), 4: (4.0, None)}),
        (merge.OVERWRITE_EXISTING, {2: (2.005, None), 3: (3.0, 31.0)}),
        (merge.UPDATE_ONLY, {2: (2.005, 20.0), 3: (3.0, 31.0)}),
    ],
)
def test_policies(spark, policy, expected):
    assert run(spark, policy, 0.01) == {1: (1.0, None), **expected}


def test_unknown_policy_is_an_error(spark):
    with pytest.raises(ValueError):
        run(spark, "nonsense")


rows = st.dictionaries(
    st.integers(0, 5), st.tuples(st.one_of(st.none(), st.integers(0, 3).map(float)), st.one_of(st.none(), st.integers(0, 3).map(float))), max_size=5
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(old=rows, new=rows)
def test_merging_twice_changes_nothing_more(spark, old, new):
    flat = lambda d: [(k, *v) for k, v in d.items()]
    old_df, new_df = spark.createDataFrame(flat(old), SCHEMA), spark.createDataFrame(flat(new), SCHEMA)
    for policy in merge.POLICIES:
        once = merge.merge_frames(old_df, new_df, ["k"], policy)
        twice = merge.merge_frames(once, new_df, ["k"], policy)
        assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, twice.collect()), key=repr)


def test_merge_adds_columns_of_either_side(spark):
    old = spark.createDataFrame([(1, 1.0)], "k int, a double")
    new = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, c double")
    out = {r.k: (r.a, r.c) for r in merge.merge_frames(old, new, ["k"], merge.FILL_NULL).collect()}
    assert out == {1: (1.0, 5.0), 2: (None, 6.0)}


def test_parquet_merge_touches_only_its_partitions_and_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k int, a double, part string"
    first = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y")], schema)
    merge.merge_into_parquet(spark, path, first, ["k"], merge.FILL_NULL, "part")
    untouched = sorted(f.name for f in (tmp_path / "t" / "part=x").iterdir())
    fresh = spark.createDataFrame([(2, 7.0, "y"), (3, 8.0, "z")], schema)
    for _ in range(2):
        merge.merge_into_parquet(spark, path, fresh, ["k"], merge.FILL_NULL, "part")
        got = {r.k: (r.a, r.part) for r in spark.read.parquet(path).collect()}
        assert got == {1: (1.0, "x"), 2: (7.0, "y"), 3: (8.0, "z")}
    assert sorted(f.name for f in (tmp_path / "t" / "part=x").iterdir()) == untouched


def test_change_counts_and_control_columns(spark):
    old, new = spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA)
    got = {r.column_name: (r.n_changed, r.is_control) for r in merge.change_counts(old, new, ["k"], ["a", "b"], 0.01, ("b",)).collect()}
    assert got == {"a": (1, False), "b": (1, True)}


def test_insert_range_is_exact_and_update_range_wider(spark):
    old = spark.createDataFrame([(2, None, None), (6, None, None)], SCHEMA)
    new = spark.createDataFrame([(k, 1.0, None) for k in range(1, 9)], SCHEMA)
    out = merge.ranged_merge(old, new, "k", (F.lit(4), F.lit(5)), (F.lit(2), F.lit(5)), merge.FILL_NULL)
    assert {r.k: r.a for r in out.collect()} == {2: 1.0, 4: 1.0, 5: 1.0, 6: None}


def test_joins_never_multiply_keys(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    out = joins.left_with_suffix(a, a, ["k"], "_b")
    assert out.columns == ["k", "v", "v_b"] and dedupe.repeated_keys(out, ["k"]).count() == 0
    with pytest.raises(ValueError):
        dedupe.require_unique(a.union(a), ["k"])


def test_blocks_outer_join_equals_pairwise_joins(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, a double")
    b = spark.createDataFrame([(2, 3.0), (3, 4.0)], "k int, b double")
    got = {tuple(r) for r in joins.outer_blocks([a, b], "k").collect()}
    assert got == {tuple(r) for r in joins.full_outer(a, b, ["k"]).collect()} == {(1, 1.0, None), (2, 2.0, 3.0), (3, None, 4.0)}


def test_stored_null_is_a_difference_and_fresh_null_is_not(spark):
    got = {
        r.k: (r.diff_a, r.diff_b)
        for r in joins.compare_values(spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA), ["k"], ["a", "b"], 0.5).collect()
    }
    assert got == {2: (False, False), 3: (True, True)}


def test_added_columns_survive_later_merges(spark, tmp_path):
    path = str(tmp_path / "t")
    put = lambda rows, cols: merge.merge_into_parquet(spark, path, spark.createDataFrame(rows, cols), ["k"], merge.UPSERT, "part")
    put([(1, 1.0, "m1")], "k int, a double, part string")
    put([(2, 2.0, 7.0, "m2")], "k int, a double, b double, part string")
    put([(3, 3.0, "m2")], "k int, a double, part string")
    got = {r.k: (r.a, r.b) for r in spark.read.option("mergeSchema", "true").parquet(path).collect()}
    assert got == {1: (1.0, None), 2: (2.0, 7.0), 3: (3.0, None)}


def test_a_policy_without_inserts_leaves_an_absent_table_absent(spark, tmp_path):
    path = str(tmp_path / "t")
    merge.merge_into_parquet(spark, path, spark.createDataFrame([(1, 1.0, "m1")], "k int, a double, part string"), ["k"], merge.UPDATE_ONLY, "part")
    assert not (tmp_path / "t").exists()


def merged(spark, path, rows, policy, **how):
    merge.merge_into_parquet(spark, path, spark.createDataFrame(rows, "k int, a double, seen int, part string"), ["k"], policy, "part", **how)


def kept(spark, path):
    return sorted((tuple(r) for r in spark.read.option("mergeSchema", "true").parquet(path).select("k", "a", "seen", "part").collect()), key=repr)


def test_every_policy_twice_gives_the_same_table(spark, tmp_path):
    for policy in merge.POLICIES:
        path = str(tmp_path / policy)
        merged(spark, path, [(1, 1.0, 1, "m1"), (None, 2.0, 1, "m1"), (3, None, 1, "m2")], merge.UPSERT)
        fresh = [(None, 5.0, 2, "m1"), (1, 6.0, 2, "m1"), (3, 7.0, 2, "m2"), (4, 8.0, 2, "m3")]
        merged(spark, path, fresh, policy, tol=0.01)
        once = kept(spark, path)
        merged(spark, path, fresh, policy, tol=0.01)
        assert kept(spark, path) == once
        assert len(once) == (3 if policy in merge.NO_INSERT else 4) and len({r[0] for r in once}) == len(once)


def test_repeated_fresh_keys_are_an_error_or_the_newest_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    merged(spark, path, [(1, 1.0, 1, "m1")], merge.UPSERT)
    twice = [(1, 2.0, 2, "m1"), (1, 3.0, 3, "m1"), (None, 4.0, 1, "m1"), (None, 5.0, 2, "m1")]
    with pytest.raises(Exception, match="repeat a key"):
        merged(spark, path, twice, merge.UPSERT)
    merged(spark, path, twice, merge.UPSERT, order=["seen"])
    assert kept(spark, path) == [(1, 3.0, 3, "m1"), (None, 5.0, 2, "m1")]


def test_an_older_row_in_a_later_batch_changes_nothing(spark, tmp_path):
    for policy, want in ((merge.UPSERT, 9.0), (merge.OVERWRITE_DIFFERENT, 9.0), (merge.PREFER_FRESH, 9.0), (merge.FILL_NULL, 1.0)):
        path = str(tmp_path / policy)
        merged(spark, path, [(1, 1.0, 1, "m1"), (2, None, 5, "m1")], merge.UPSERT, order=["seen"])
        merged(spark, path, [(1, 9.0, 7, "m1")], policy, order=["seen"])
        merged(spark, path, [(1, 4.0, 6 if policy != merge.FILL_NULL else 0, "m1"), (2, 3.0, 2, "m1")], policy, order=["seen"])
        got = {r[0]: r[1] for r in kept(spark, path)}
        assert got[1] == want and got[2] == (3.0 if policy == merge.FILL_NULL else None)


def test_a_key_moves_with_its_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    merged(spark, path, [(1, 1.0, 1, "m1"), (2, 2.0, 1, "m1"), (3, 3.0, 1, "m2"), (4, 4.0, 1, None)], merge.UPSERT)
    merged(spark, path, [(1, 9.0, 1, "m2"), (3, 8.0, 1, "m9"), (4, 7.0, 1, "m1")], merge.UPSERT)
    assert kept(spark, path) == [(1, 9.0, 1, "m2"), (2, 2.0, 1, "m1"), (3, 8.0, 1, "m9"), (4, 7.0, 1, "m1")]
    merged(spark, path, [(2, 5.0, 1, "m2"), (4, 5.0, 1, "m2")], merge.UPSERT)
    assert kept(spark, path) == [(1, 9.0, 1, "m2"), (2, 5.0, 1, "m2"), (3, 8.0, 1, "m9"), (4, 5.0, 1, "m2")]
    # a policy that keeps what is stored moves nothing
    merged(spark, path, [(1, 0.0, 1, "m7")], merge.INSERT_IGNORE)
    assert (1, 9.0, 1, "m2") in kept(spark, path)
