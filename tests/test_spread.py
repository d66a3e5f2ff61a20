"""The plans of spread.py give the rows of the SELECTs they stand for, of files that repeat, lack lines or have many as well."""

import pandas as pd
import pytest
from oracle import same, views

from sparkledger.plans.bind import Bound, with_bindings
from sparkledger.plans.spread import PLANS


@pytest.fixture(scope="module", params=["plain", "odd"])
def folder(request, tmp_path_factory):
    if request.param == "plain":
        return "/root/testdata/sf0.001"
    d = tmp_path_factory.mktemp("odd")
    keys = [(k, k % 7, "FOP"[k % 3]) for k in range(1, 60)] + [(8, 1, "F"), (10**12, 3, "P"), (-5, 3, "O"), (9, 3, "P")]
    pd.DataFrame(keys, columns=["o_orderkey", "o_custkey", "o_orderstatus"]).to_parquet(d / "orders.parquet")
    lines = [(k, i + 1, (k * 31 + i) % 97, k % 2, float(k % 50 + i), 1.0 + i, "1995-01-01") for k in [*range(3, 70), -5, 10**12] for i in range(k % 11)]
    pd.DataFrame(lines, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]).to_parquet(d / "lineitem.parquet")
    pd.DataFrame({"s_suppkey": [0, 1]}).to_parquet(d / "supplier.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_rows_of_the_select(spark, folder, name):
    frame = getattr(Bound(spark, folder), name).toPandas()
    columns = [c for c in frame.columns if c != "log_offset" or "odd" not in folder]
    con = views(folder)
    same(frame[columns], con, f"{with_bindings(name)} SELECT {', '.join(columns)} FROM {name}")
    if name == "meta_log":
        for _, part in frame.groupby("namespace"):
            assert sorted(part.log_offset) == list(range(len(part)))
            at = part.sort_values("log_offset")
            assert at.file_id.is_monotonic_increasing


@pytest.mark.parametrize("name", sorted(PLANS))
def test_no_task_has_a_whole_namespace(spark, name):
    import re

    plan = getattr(Bound(spark, "/root/testdata/sf0.001"), name)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(namespace#\d+, \d+\)", plan) and "SinglePartition" not in re.sub(r"Exchange SinglePartition[^\n]*\n[^\n]*partial_(count|min)", "", plan)


@pytest.mark.parametrize("name", "replica_verdicts fold_replicas descriptor_diff readable_replicas seal_replica delete_replica confirm_deletes open_replica evict_short delete_counters orphan_budgets".split())
def test_replicas_stay_with_their_file(spark, name):
    """Rows of replicas are shuffled by file_id, before they are replicas, and not again by chunk, replica, node or namespace."""
    import re

    from sparkledger.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keys = {re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\((.*), \d+\)", plan)}
    allowed = {"l_orderkey", "file_id", "o_orderkey"} | ({"node_id, namespace", "node_id", "namespace"} if name == "orphan_budgets" else {"code"} if name == "delete_counters" else set())
    assert keys <= allowed, keys
    # The distinct namespaces of the files only, not the rows they are joined to.
    assert len(re.findall(r"hashpartitioning\(namespace#\d+, \d+\)", plan)) == (name == "orphan_budgets")
