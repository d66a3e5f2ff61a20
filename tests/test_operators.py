"""Small literal cases for semantics that the synthetic tables do not reach."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkledger.functions import scalar as X
from sparkledger.operators import fold, gc, health, metrics, offsets, placement, prefix, votes
from sparkledger.sources import files as sources


def frame(spark, columns, data):
    return spark.createDataFrame(data, columns)


def vote_rows(spark, data):
    return frame(spark, "namespace string, file_id long, idx long, vote_seq long, final_length long, crc long, node_id long", [("t", 1, 0, i, *v) for i, v in enumerate(data)])


@pytest.mark.parametrize(
    "data, quorum, expected",
    [
        ([(1, 11, 1), (1, 11, 2), (1, 22, 1), (1, 22, 2), (1, 22, 3)], 2, (1, 22, "1,2,3", 5, True)),
        ([(1, 11, 1), (1, 11, 2), (1, 22, 2), (1, 22, 3)], 2, (1, 11, "1,2", 4, True)),
        ([(4, 10, 9), (4, 11, 1), (4, 11, 2)], 2, (4, 11, "1,2", 3, True)),
        ([(4, 10, 9), (4, 11, 1), (4, 11, 2)], 3, None),
    ],
)
def test_seal_votes(spark, data, quorum, expected):
    out = votes.seal_votes(vote_rows(spark, data), quorum).collect()
    assert [(r.final_length, r.crc, r.nodes, r.total, r.divergent) for r in out] == ([expected] if expected else [])


def test_owners_clamp_and_move_only_to_the_new_endpoint(spark):
    names = frame(spark, "namespace string", [(f"ns-{i}",) for i in range(300)])
    ends = lambda n: frame(spark, "endpoint string", [(f"m{i}:9301",) for i in range(1, n + 1)])
    sizes = [placement.owners(names.limit(1), ends(3), 1, k).count() for k in (3, 2, 1, 9, 0)]
    assert sizes == [3, 2, 1, 3, 1]
    lead = lambda n: {r.namespace: r.endpoint for r in placement.owners(names, ends(n), 1, 1).collect()}
    three, four = lead(3), lead(4)
    assert set(three.values()) == {"m1:9301", "m2:9301", "m3:9301"}
    moved = {k for k in three if three[k] != four[k]}
    assert {four[k] for k in moved} <= {"m4:9301"} and 0 < len(moved) < 150
    assert placement.owners(names, ends(0), 1, 3).count() == 0


def test_prefix_stops_at_the_first_bad_entry(spark):
    e = frame(spark, "namespace string, file_id long, seq long, end_offset long, payload_ok boolean, entry_ok boolean, data_present boolean",
              [("a", 1, 1, 10, True, True, True), ("a", 1, 2, 20, True, False, True), ("a", 1, 3, 30, True, True, True), ("b", 2, 1, 5, False, True, True), ("c", 3, 1, 5, True, True, True)])
    assert {(r.namespace, r.seq) for r in prefix.ledger_prefix(e).collect()} == {("a", 1), ("b", 1), ("c", 1)}
    durable = frame(spark, "namespace string, file_id long, durable_offset long", [("a", 1, 20), ("c", 3, 4)])
    got = {r.namespace: (r.verified_end, r.durable_offset, r.truncated) for r in prefix.recover(e, durable).collect()}
    assert got == {"a": (10, 10, True), "b": (0, 0, True), "c": (5, 4, False)}


def test_ledger_must_increase(spark):
    e = frame(spark, "namespace string, file_id long, seq long, end_offset long, entry_ok boolean", [("a", 1, 1, 10, True), ("a", 1, 2, 10, True), ("a", 1, 3, 30, True)])
    assert [r.seq for r in prefix.ledger_prefix(e).collect()] == [1]


def test_budgets(spark):
    c = frame(spark, "node_id long, namespace string, orphans long, sealed long", [(1, "a", 50, 100), (1, "b", 5, 3), (1, "c", 9, 0), (1, "d", 40, 400)])
    got = {r.namespace: r.allowed for r in gc.budgets(c, 30, 25, 40).collect()}
    assert got == {"a": 25, "b": 1, "c": 0, "d": 14}
    assert {r.namespace: r.allowed for r in gc.budgets(c, 0, 0, 0).collect()} == {"a": 50, "b": 5, "c": 9, "d": 40}


def test_system_paths_of_odd_namespaces(spark):
    f = frame(spark, "path string", [("/metadata-log/metadata-log/gen-7/log-1",), ("/metadata-log/gen-7/gen-2/snapshot-x",), ("/metadata-log/gen-7/log-1",), ("/other/a/gen-1/log-1",), ("/metadata-log/a/gen-x/log-1",)])
    got = [(r.p_namespace, r.p_generation) for r in gc.parse_system_path(f).collect()]
    assert got == [("metadata-log", 7), ("gen-7", 2), (None, None), (None, None), (None, None)]


def log(spark, *records):
    rows = [("t", i, kind, f, idx, path, length, epoch, at) for i, (kind, f, idx, path, length, epoch, at) in enumerate(records)]
    return frame(spark, "namespace string, log_offset long, kind string, file_id long, idx long, path string, length long, write_epoch long, at_ms long", rows)


def test_fold_delete_and_sweep(spark):
    made = ("FileCreated", 1, -1, "/logs/seg-0", None, None, 1000)
    chunk = ("ChunkCreated", 1, 0, None, 0, 1, None)
    sealed = ("ChunkSealed", 1, 0, None, 4096, 1, None)
    aborted = ("ChunkAborted", 1, 0, None, None, None, None)
    going, gone, swept = ("FileDeleting", 1, -1, None, None, None, None), ("FileDeleted", 1, -1, None, None, None, 5000), ("TombstoneSwept", 1, -1, None, None, None, None)
    unbound = ("PathUnbound", 1, -1, "/logs/seg-0", None, None, None)
    one = lambda *r: fold.file_state(log(spark, *r)).collect()
    assert [(r.state, r.version) for r in one(made)] == [("OPEN", 0)]
    assert [(r.state, r.length) for r in fold.chunk_state(log(spark, made, chunk, sealed)).collect()] == [("SEALED", 4096)]
    assert fold.chunk_state(log(spark, made, chunk, aborted)).count() == 0
    assert [(r.state, r.deleted_at_ms) for r in one(made, going, unbound, gone)] == [("DELETED", 5000)]
    assert fold.bindings(log(spark, made, going, unbound)).count() == 0
    assert one(made, going, unbound, gone, swept) == []
    assert fold.high_water(log(spark, made, going, unbound, gone, swept)).first().next_file_id == 2
    assert [r.state for r in one(made, going, gone, swept, made)] == ["OPEN"]


def test_fold_ignores_what_is_not_there(spark):
    made, sealed, swept = ("FileCreated", 1, -1, "/a", None, None, 1), ("FileSealed", 1, -1, None, None, None, None), ("TombstoneSwept", 1, -1, None, None, None, None)
    chunk, chunk_sealed = ("ChunkCreated", 1, 0, None, 0, 1, None), ("ChunkSealed", 1, 0, None, 9, 1, None)
    assert fold.file_state(log(spark, sealed, made, swept, sealed)).count() == 0
    assert fold.chunk_state(log(spark, made, chunk_sealed)).count() == 0
    assert [r.length for r in fold.chunk_state(log(spark, made, chunk, chunk_sealed, chunk)).collect()] == [0]
    assert fold.chunk_state(log(spark, made, chunk, swept, made)).count() == 0
    again = fold.file_state(log(spark, made, sealed, made, chunk)).first()
    assert (again.state, again.version) == ("OPEN", 3)
    gone = fold.file_state(log(spark, made, sealed, swept, made, chunk)).first()
    assert (gone.state, gone.version) == ("OPEN", 1)


def test_replica_edits(spark):
    rows = [("t", 1, 0, 1, "ChunkSealed", n, None) for n in (1, 2, 3)] + [("t", 1, 0, 2, "ReplicaSwapped", 3, 4), ("t", 1, 0, 3, "ReplicaDropped", 4, None), ("t", 1, 0, 4, "ReplicaAdded", 5, None)]
    rows += [("t", 2, 0, 1, "ChunkCreated", n, None) for n in (1, 2, 3)] + [("t", 2, 0, 2, "ChunkSealed", n, None) for n in (1, 2)] + [("t", 3, 0, 1, "ChunkCreated", 1, None), ("t", 3, 0, 2, "ChunkDeleted", None, None)]
    got = {r.file_id: r.replicas for r in fold.replica_lists(frame(spark, "namespace string, file_id long, idx long, log_offset long, kind string, node_id long, to_node long", rows)).collect()}
    assert got == {1: [1, 2, 5], 2: [1, 2]}


def test_snapshot_and_tail_give_the_whole_fold(spark):
    rng = random.Random(3)
    kinds = [("FileCreated", "/p"), ("FileSealed", None), ("WriterEpochAllocated", None), ("FileDeleting", None), ("FileDeleted", None), ("TombstoneSwept", None), ("ChunkCreated", None), ("PathUnbound", "/p")]
    records = [(k, rng.randrange(4), -1, p and f"{p}{i}", None, i, i) for i in range(120) for k, p in [rng.choice(kinds)]]
    whole = log(spark, *records).cache()
    want = sorted(map(tuple, fold.file_state(whole).collect()))
    for cut in (0, 1, 40, 90, 120):
        assert sorted(map(tuple, fold.resume(*fold.snapshot_tail(whole, cut)).collect())) == want


def test_snapshot_choice(spark):
    m = frame(spark, "namespace string, generation long", [("a", 3), ("b", 3), ("c", 3), ("d", 3)])
    s = frame(spark, "namespace string, generation long, cut long, readable boolean", [("a", 3, 50, True), ("b", 3, 50, False), ("b", 2, 20, True), ("c", 2, 20, True), ("d", 2, 20, False)])
    g = frame(spark, "namespace string, first long, last long", [("b", 10, 30), ("b", 31, 60), ("c", 10, 30), ("c", 32, 60)])
    assert {r.namespace: (r.source, r.cut) for r in fold.usable_snapshot(m, s, g).collect()} == {"a": ("CURRENT", 50), "b": ("PREVIOUS", 20), "c": ("REFUSED", None), "d": ("REFUSED", None)}


def test_the_last_live_replica_stays(spark):
    key = "namespace string, file_id long, idx long, node_id long"
    rep = frame(spark, f"{key}, state string, length long, crc long", [("t", f, 0, n, "SEALED", 5, 7) for f in (1, 2) for n in (1, 2)])
    nodes = frame(spark, "node_id long, state string, host string, endpoint string", [(1, "REGISTERED", "h", "e"), (2, "DEAD", "h", "e")])
    bad = frame(spark, f"{key}, state string, length long, crc long", [("t", 1, 0, 1, "SEALED", 5, 8), ("t", 2, 0, 1, "SEALED", 5, 8)])
    since = frame(spark, f"{key}, since_ms long", [("t", 1, 0, 1, 0), ("t", 2, 0, 1, 0)])
    none = since.limit(0)
    judge = lambda nodes: {(r.file_id, r.node_id): r.verdict for r in health.verdicts(rep, bad, nodes, 100, 50, since, none).collect()}
    assert judge(nodes)[1, 1] == "keep-last-live" and judge(nodes)[1, 2] == "no-answer"
    both = judge(nodes.withColumn("state", F.lit("REGISTERED")))
    assert both[1, 1] == "drop-corrupt" and both[1, 2] == "keep-last-live"


def test_backoff_never_exceeds_the_cap(spark):
    got = spark.range(200).select(X.backoff(20, F.col("id") % 20, 5000, F.col("id")).alias("w")).agg(F.min("w"), F.max("w")).first()
    assert 20 <= got[0] <= 22 and got[1] == 5000


def test_two_right_rows_are_an_error(spark):
    left = frame(spark, "i long, value long", [(1, 2)])
    with pytest.raises(Exception, match="many-to-one"):
        metrics.matched_product(left, frame(spark, "i long, value long", [(1, 2), (1, 3)]), ["i"]).collect()


def test_tombstone_cutoff_is_inclusive(spark):
    f = frame(spark, "state string, deleted_ms long", [("DELETED", 5000), ("OPEN", 1)])
    assert gc.expired_tombstones(f, 5000).count() == 1 and gc.expired_tombstones(f, 4999).count() == 0


def test_chunk_rolls(spark):
    r = frame(spark, "namespace string, file_id long, seq long, length long", [("a", 1, i, n) for i, n in enumerate([5, 5, 9, 1, 1, 1, 20, 1], 1)])
    got = [(x.chunk, x.chunk_offset) for x in offsets.chunk_rolls(r, 10, 3).orderBy("seq").collect()]
    assert got == [(0, 0), (0, 5), (1, 0), (1, 9), (2, 0), (2, 1), (2, 2), (3, 0)]


def test_counter_reset_and_quantile(spark):
    s = frame(spark, "metric string, instance long, series long, ts_ms long, value long", [("m", 1, 1, t, v) for t, v in enumerate([5, 9, 2, 3], 1)])
    assert metrics.increases(s, 0, 10).first().increase == 7
    w = s.sparkSession.createDataFrame([("m", 0, 0, t, v) for t, v in ((0, 9), (1, 5), (10, 8), (11, 2), (20, 4), (41, 1))], "metric string, instance int, series int, ts_ms long, value long")
    assert sorted((r.slot, r.increase) for r in metrics.increases_by_window(w, 10).collect()) == [(-1, 0), (0, 3), (1, 2), (4, 0)]
    assert sorted((r.slot, r.rate) for r in metrics.rate_by_window(w, 10, ["metric"]).collect()) == [(-1, 0.0), (0, 300.0), (1, 200.0), (4, 0.0)]
    h = frame(spark, "k string, le double, cum long", [("a", 1.0, 0), ("a", 2.0, 10), ("a", float("inf"), 10), ("b", 1.0, 0), ("b", float("inf"), 4)])
    assert {r.k: r.quantile for r in metrics.histogram_quantile(h, 0.5, ["k"]).collect()} == {"a": 1.5, "b": 1.0}


def test_crc32c(spark):
    assert X.crc32c_many([b"123456789", b"", None, b"a" * 1000]).tolist()[:3] == [0xE3069283, 0, 0]
    df = spark.createDataFrame(pd.DataFrame({"id": [1, 2], "p": [b"123456789", None]}))
    assert {r.id: r.crc for r in X.with_crc32c(df, "p").collect()} == {1: 0xE3069283, 2: None}


def test_varints():
    data = [0, 1, 127, 128, 300, 2**63, 2**64 - 1]
    assert X.decode_varints(b"".join(map(X.encode_varint, data))) == data
    with pytest.raises(ValueError):
        X.decode_varints(b"\x80")


def test_snapshot_pointer_and_walk(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    for cut in (3, 8):
        sources.write_snapshot(spark.range(cut), root, cut)
        state, at = sources.read_snapshot(spark, root)
        assert (state.count(), at) == (cut, cut)
    assert sources.snapshot_version(spark, root) == 2
    with pytest.raises(FileExistsError):
        sources.write_snapshot(spark.range(5), root, 9, expected=1)
    assert sources.read_snapshot(spark, root)[1] == 8
    good = tmp_path / "chunks" / "ns" / "2a" / "00"
    good.mkdir(parents=True)
    (good / "000000000000002a.3").write_bytes(b"abc")
    (good / "stray.tmp").write_bytes(b"x")
    chunks, stray = sources.walk_chunks(spark, f"file://{tmp_path}/chunks")
    assert [(r.namespace, r.file_id, r.idx, r.length) for r in chunks.collect()] == [("ns", 42, 3, 3)] and stray.count() == 1
