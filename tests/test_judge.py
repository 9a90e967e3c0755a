"""Verdicts on writes, in one batch and as a stream of approvals."""

from test_state_and_fixpoints import run_stream

from quartzite.operators import judge
from quartzite.streaming import policy_state


def test_approvals_are_spent_once_and_by_their_write(spark):
    writes = [(1, 1, "a"), (2, 3, "a"), (3, 4, "a"), (4, 7, "b"), (5, 8, "b"), (6, 9, "c"), (7, 10, "d")]
    found = [(1, "Escalate"), (2, "Escalate"), (3, "Escalate"), (4, "Escalate"), (4, "Deny"), (5, "Escalate"), (6, "Warn")]
    w = spark.createDataFrame(writes, "write long, seq long, token string")
    v = spark.createDataFrame(found, "write long, enforcement string")
    a = spark.createDataFrame([(2, "a"), (2, "a"), (5, "b"), (6, "b"), (9, "c")], "seq long, token string")
    got = {r.write: r.verdict for r in judge.verdicts(w, v, a).collect()}
    assert got == {1: "escalate", 2: "approved", 3: "escalate", 4: "deny", 5: "approved", 6: "allow", 7: "allow"}
    assert judge.verdicts(w.limit(0), v, a).count() == 0


def test_old_violations_are_not_held_against_a_write(spark):
    now = spark.createDataFrame([(1, "r", "m", "Deny")] * 3 + [(2, "r", "m", "Deny")], "write long, rule_id string, message string, enforcement string")
    before = spark.createDataFrame([(1, "r", "m")] * 2 + [(2, "r", "n")], "write long, rule_id string, message string")
    assert sorted(r.write for r in judge.new_violations(now, before).collect()) == [1, 2]


def test_stream_of_approvals(spark, tmp_path):
    batches = [[("a", 1, "ask"), ("a", 2, "approve")], [("a", 3, "approve"), ("b", 4, "ask")], [("a", 5, "ask"), ("a", 6, "ask")]]
    rows = run_stream(spark, tmp_path, "token string, seq long, kind string", batches, policy_state.approvals)
    assert sorted(rows) == [("a", 1, False), ("a", 5, True), ("a", 6, False), ("b", 4, False)]
