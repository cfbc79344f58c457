"""Publishing graph generations: two publishers, clocks, failed jobs."""

import dataclasses

import pytest
from palisade.sources import snapshots
from palisade.sources.model import SCHEMAS, graph_of


def policies(spark, n):
    return graph_of(spark, policies=spark.createDataFrame([(f"p{i}", "ALLOW", None, None) for i in range(n)], SCHEMAS["policies"]))


def count(spark, root):
    return snapshots.read(spark, root).policies.count()


def test_two_publishers_from_one_state(spark, tmp_path, monkeypatch):
    root, real = f"file://{tmp_path}/g", snapshots.commit
    assert snapshots.publish(policies(spark, 1), root, digest="a") == 1

    def late(s, r, entry):  # another publisher commits between this one's look at the log and its own commit
        monkeypatch.setattr(snapshots, "commit", real)
        assert snapshots.publish(policies(spark, 2), root, digest="b") == 2
        won = real(s, r, entry)
        assert not won
        return won

    monkeypatch.setattr(snapshots, "commit", late)
    assert snapshots.publish(policies(spark, 3), root) == 3
    state = snapshots.head(spark, root)
    assert (state.number, state.parent, state.governance_digest, count(spark, root)) == (3, 2, "b", 3)
    with pytest.raises(snapshots.StaleState):
        snapshots.publish(policies(spark, 4), root, based_on=2)
    assert count(spark, root) == 3 and snapshots.publish(policies(spark, 4), root, based_on=3) == 4


def test_clocks_decide_nothing(spark, tmp_path, monkeypatch):
    root, real = f"file://{tmp_path}/g", snapshots.commit
    for i, year in enumerate((2030, 2020, 1990)):
        monkeypatch.setattr(snapshots, "commit", lambda s, r, e, y=year: real(s, r, dataclasses.replace(e, updated_at=f"{y}-01-01T00:00:00+00:00")))
        snapshots.publish(policies(spark, i + 1), root)
        assert snapshots.graph_state(spark, root).first().generation == i + 1 and count(spark, root) == i + 1
    snapshots.reset(spark, root)
    state = snapshots.graph_state(spark, root).first()
    assert (state.generation, state.governance_digest, count(spark, root)) == (0, None, 0)


def test_an_earlier_state_stays_readable(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    assert snapshots.head(spark, root) is None and count(spark, root) == 0
    snapshots.publish(policies(spark, 1), root)
    old = snapshots.head(spark, root)
    snapshots.publish(policies(spark, 2), root)
    (tmp_path / "g/log/_left-by-a-failed-job").write_text("{")
    assert snapshots.read(spark, root, old).policies.count() == 1 and count(spark, root) == 2


def test_labels_every_row(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    snapshots.publish(policies(spark, 2), root)
    rows = snapshots.stamped(snapshots.read(spark, root).policies.select("id"), snapshots.graph_state(spark, root)).collect()
    assert len(rows) == 2 and all(r.generation == 1 and r.graph_state_verified for r in rows)
