"""Registered participants beyond the first 150, on a small fixture."""

import datetime

import pytest

from signalmill.plans import queries as plans

N = 400


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("participants")
    people = [(k, float(k), k % 25) for k in range(1, N + 1)]
    spark.createDataFrame(people, "c_custkey long, c_acctbal double, c_nationkey int").write.parquet(f"{root}/customer.parquet")
    at = datetime.datetime(2024, 1, 1)
    # even events are own points; a user without a customer has none
    events = [(2 * i, at, u, "click", 1.0) for i, u in enumerate([3, 149, 150, 151, 399, 399, 400])]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{root}/events.parquet")
    return str(root)


def test_settlement_of_all_participants(spark, folder):
    out = {r.hotkey: r.reward for r in plans.q_settlement(spark, folder).collect()}
    assert out == {"hk3": 1, "hk149": 1, "hk150": 1, "hk151": 1, "hk399": 2}
    payload = {r.hotkey: r.points for r in plans.q_reward_payload(spark, folder).collect()}
    assert payload == {k: float(v) for k, v in out.items()}
    weights = {r.uid: r.weight for r in plans.q_weights_floor_scale_burn(spark, folder).collect()}
    assert weights.keys() == set(range(N)) and {u for u, w in weights.items() if u and w} == {3, 149, 150, 151, 399}


@pytest.mark.parametrize("name", ["q_weights_cap", "q_l1_norm"])
def test_weights_of_all_participants(spark, folder, name):
    assert sorted(r.uid for r in plans.QUERIES[name](spark, folder).collect()) == list(range(N))


def test_registry_sets_length_and_bound(spark, folder):
    dense = {r.uid: r.weight for r in plans.q_dense_weights(spark, folder).collect()}
    assert dense == {u: float(u + 1) if u < N else 0.0 for u in range(N + 10)}
    scores = {r.uid: r.score for r in plans.q_resync(spark, folder).collect()}
    assert scores == {u: 0.0 if u % 9 == 0 or u >= N - 10 else float(u + 1) for u in range(N)}
