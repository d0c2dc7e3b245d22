"""Session rules: every branch, on rows made for it."""

import hashlib

from pyspark.sql import functions as F
from sievework.functions import sessions as S
from sievework.operators import sessions as O


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def event(kind, sequence, call=None, tool=None, given=None, status=None, content=None):
    return (kind, sequence, call, tool, given, status, content)


USER, CALL, RESULT = event("user_input", 1, content="hi"), event("tool_call", 2, "c1", "read", "f"), event("tool_result", 3, "c1", "read", None, "completed", "")
CASES = [
    ([USER, CALL, RESULT, event("assistant_output", 9, content="done")], None, None),
    ([], "no_calls", 1), (None, "no_calls", 1), ([USER], "no_calls", 2),
    ([event("user_input", None, content="x")], "sequence", 1), ([event("user_input", 0, content="x")], "sequence", 1),
    ([USER, event("tool_call", 1, "c1", "read", "f")], "sequence_order", 2),
    ([event("user_input", 1, content="  ")], "text", 1), ([event("user_input", 1)], "text", 1),
    ([USER, CALL, event("assistant_output", 3, content="x")], "result_not_adjacent", 3),
    ([USER, CALL, event("tool_call", 3, "c2", "read", "f")], "call_not_adjacent", 3),
    ([event("tool_call", 1, "!", "read", "f")], "call_form", 1), ([event("tool_call", 1, "c1", "Read", "f")], "call_form", 1), ([event("tool_call", 1, None, "read", "f")], "call_form", 1),
    ([USER, CALL, RESULT, event("tool_call", 4, "c1", "read", "f")], "call_repeated", 4),
    ([event("tool_call", 1, "c1", "read", "other")], "not_approved", 1),
    ([RESULT], "result_pairing", 1), ([USER, CALL, event("tool_result", 3, "c2", "read", None, "completed", "")], "result_pairing", 3),
    ([USER, CALL, event("tool_result", 4, "c1", "read", None, "completed", "")], "result_pairing", 3), ([USER, CALL, event("tool_result", 3, "c1", "read", None, "lost", "")], "result_pairing", 3),
    ([USER, CALL, event("tool_result", 3, "c1", "read", None, "error", None)], "result_content", 3),
    ([event("note", 1)], "event_type", 1), ([event(None, 1)], "event_type", 1),
    ([USER, CALL], "open_call", 3),
    ([USER, CALL, RESULT, event("note", 4), event("note", 1)], "event_type", 4),
]


def test_trajectory(spark):
    df = spark.createDataFrame([(i, c[0], [sha("read\nf")]) for i, c in enumerate(CASES)], f"id int, events array<{S.EVENT}>, approved array<string>")
    got = {r.id: r.r for r in df.select("id", S.trajectory(F.col("events"), F.col("approved")).alias("r")).collect()}
    for i, (_, code, at) in enumerate(CASES):
        assert (got[i].code, got[i].at) == (code, at), CASES[i]
    assert got[0].calls == 1 and got[0].results == 1
    none = df.where("id = 0").select(S.trajectory(F.col("events"), F.lit(None).cast("array<string>")).alias("r")).first().r
    assert none.code == "not_approved"


def test_audit(spark):
    pairs = "array<struct<revision: int, digest: string>>"
    a = [(1, "x"), (2, "y")]
    cases = [(a, a, None, None), (a, a[:1], "count", None), (a, None, "count", None), (a, [(1, "x"), (3, "y")], "revision", 2), (a, [(1, "z"), (3, "y")], "digest", 1), ([], [], None, None), (None, None, None, None)]
    df = spark.createDataFrame([(i, s, b) for i, (s, b, *_) in enumerate(cases)], f"id int, s {pairs}, a {pairs}").select("id", S.audit(F.col("s"), F.col("a")).alias("r"), S.hash_chain(F.col("s.digest")).alias("chain"))
    for r in df.collect():
        assert (r.r and r.r.code, r.r and r.r["at"]) == cases[r.id][2:]
    assert df.first().chain == sha(sha("x") + "y")


def test_credential(spark):
    secret = "Tr0ub4dor"
    texts = [(1, f"a token zz{secret}yy"), (2, secret), (3, "Tr0ub 4dor"), (4, None), (5, ""), (6, "short"), (7, "x" * 5000 + secret)]
    df = spark.createDataFrame(texts, "id int, t string")
    assert {r.id for r in df.where(S.holds_credential(F.col("t"), len(secret), sha(secret))).collect()} == {1, 2, 7}


def test_text_violation(spark):
    cases = {"plain words": None, "a\x01b": "control_text", "x" * 101: "text_size", "cut [redacted: 3]": "lossy_source", "password: hunter2hunter2": "secret", "has zzSECRETKEYyy in it": "secret",
             "so <thinking> hm": "hidden_reasoning", "see /home/me/x": "absolute_path", "C:\\temp\\x": "absolute_path", "in /work/app/src/x.py": None, "Case-ALPHA-1 here": "heldout", "": None, "www/var/x": None}
    df = spark.createDataFrame(list(cases.items()) + [(None, "not_text")], "t string, want string")
    code = S.text_violation(F.col("t"), "/work/app", 100, ["case-alpha-1", ""], (9, sha("SECRETKEY")))
    for r in df.select("t", "want", code.alias("code")).collect():
        assert r.code == r.want, r.t
    assert df.where("t LIKE '%thinking%'").select(S.text_violation(F.col("t"), "/w", 100, [], public=False).alias("c")).first().c is None


def test_partition(spark):
    rows = [("gold", i + 1, *e) for i, e in enumerate([USER, CALL, RESULT, event("assistant_output", 9, content="done")])]
    rows += [("neg", i + 1, *e) for i, e in enumerate([USER, CALL, event("assistant_output", 9, content="x")])]
    rows += [("leak", 1, *event("user_input", 1, content="/home/me")), ("leak", 2, *event("assistant_output", 2, content="[redacted:")), ("lie", 1, *USER)]
    names = [f.split(":")[0].strip() for f in S.EVENT[len("struct<"):-1].split(",")]
    events = spark.createDataFrame(rows, "id string, order int, " + ", ".join(f"{n} {'long' if n == 'sequence' else 'string'}" for n in names))
    stated = spark.createDataFrame([("gold", []), ("neg", ["result_missing"]), ("leak", []), ("lie", []), ("gone", [])], "id string, labels array<string>")
    public = F.col("type").isin("user_input", "assistant_output")
    out = O.partition_sessions(events, "id", F.when(public, S.text_violation(F.col("content"), "/w", 1000, [])), public | (F.col("type") == "tool_call"), stated, ["read"])
    got = {r.id: r for r in out.collect()}
    assert (got["gold"].disposition, got["neg"].disposition) == ("gold", "negative") and got["neg"].codes == ["result_missing"]
    assert [(m.sequence, m.type, m.content) for m in got["gold"].messages] == [(1, "user_input", "hi"), (2, "tool_call", "f"), (3, "assistant_output", "done")]
    assert got["leak"].codes == ["absolute_path", "lossy_source"] and got["leak"].messages is None and got["leak"].n_messages is None
    assert got["lie"].codes == ["labels_differ"] and got["gone"].codes == ["no_events"] and got["gone"].disposition == "reject"
