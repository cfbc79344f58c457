"""The checks of states, envelopes, provenance and manifest fields run over tables that grow."""

from collections import Counter

import __spark_entry__ as entry
from palisade.sources.lens import Lens


def run(spark, sf, name):
    return [tuple(r) for r in entry.queries()[name](spark, sf).collect()]


def test_states_envelopes_and_provenance(spark, sf):
    t = lambda n, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(*c).collect()]
    want = [(str(k), ("no digest", "no generation")[k % 3]) for (k,) in t("orders", "o_orderkey") if k % 3 < 2]
    assert sorted(run(spark, sf, "b13_state_checks")) == sorted(want)
    faults = ("digest of another manifest", "another generation", "unknown profile", "window ends before it starts", "another instance")
    assert sorted(run(spark, sf, "p1_envelope_check")) == sorted((k, faults[k % 5]) for (k,) in t("events", "event_id"))
    status = ("exact", "revalidated", "unverified")
    assert sorted(run(spark, sf, "p10_provenance_status")) == sorted((n, status[k % 3]) for n, k in t("customer", "c_name", "c_custkey"))


def test_every_manifest_table_is_checked(spark, sf):
    m = Lens(spark, sf).manifest
    ends = Counter(r.id[-1] for r in m.agents.collect())
    want = {
        "MISSING": ends["1"] + m.grants.filter("granted_by = '1-URGENT'").count(),
        "SEPARATOR": ends["2"],
        "CREDENTIAL": ends["3"],
        "EFFECT": sum(len(r.id) % 2 == 0 for r in m.policies.collect()),
        "MODE": m.data_access.filter("mode = 'READS'").count(),
        "PROVENANCE": m.bindings.filter("field = 'governed_tools'").count(),
    }
    assert dict(run(spark, sf, "v21_field_checks")) == {k: n for k, n in want.items() if n}
    print(want)
