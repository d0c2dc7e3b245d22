"""Rules of agent sessions: trajectories, audits, public text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .safety import has_secret

#: An event of a trajectory, in order.
EVENT = "struct<type: string, sequence: bigint, call_id: string, tool: string, input: string, status: string, content: string>"

# Forms and marks that a checked session is held against.
CALL_ID = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"
TOOL_ID = r"^[a-z][a-z0-9_.-]{0,79}$"
RESULT_STATUS = ["completed", "error", "rejected"]
CREDENTIAL_TOKEN = r"[A-Za-z0-9._~+/=-]{8,}"
LOSSY_MARK = "[redacted:"
HIDDEN_MARK = r"(?i)<\/?thinking>|<\/?reasoning>|chain[- ]of[- ]thought|[\"'](?:reasoning|thinking)[\"']\s*:"
ABSOLUTE_PATH = r"(?m)(?:^|[^A-Za-z0-9_])[A-Za-z]:[\\/]|(?:^|[^A-Za-z0-9_.-])/(?:home|Users|var|tmp|opt|etc)/"
CONTROL = r"[\x00-\x08]"
# End of fixed values.


def signature(tool: Column, given: Column) -> Column:
    """What an approval names: a tool with its input."""
    return F.sha2(F.concat(F.coalesce(tool, F.lit("")), F.lit("\n"), F.coalesce(given, F.lit(""))), 256)


def trajectory(events: Column, approved: Column) -> Column:
    """struct(code, at, calls, results): the first rule that a session's events break, null
    if none, and the position of the event that breaks it (from 1; past the end for rules
    on the whole).

    One pass over the array with the last sequence, the pending call and the calls so
    far.  Sequences rise; a call has a form, an id of its own and an approved
    signature; its result stands next to it, with the same id and tool and the next
    sequence; text never stands between them.  A session without calls, or with one
    that no result closes, is broken too.
    """
    start = F.struct(F.lit(None).cast("string").alias("code"), F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("last"),
                     F.lit(None).cast("string").alias("open_id"), F.lit(None).cast("string").alias("open_tool"), F.array().cast("array<string>").alias("calls"), F.lit(0).cast("bigint").alias("results"))

    def step(s: Column, e: Column) -> Column:
        pending = s.open_id.isNotNull()
        call = e.type == "tool_call"
        result = e.type == "tool_result"
        code = (F.when(e.sequence.isNull() | (e.sequence < 1), "sequence").when(e.sequence <= s["last"], "sequence_order")
                .when(e.type.isin("user_input", "assistant_output"), F.when(F.coalesce(F.trim(e.content), F.lit("")) == "", "text").when(pending, "result_not_adjacent"))
                .when(call, F.when(pending, "call_not_adjacent").when(~F.coalesce(e.call_id.rlike(CALL_ID) & e.tool.rlike(TOOL_ID), F.lit(False)), "call_form")
                      .when(F.array_contains(s.calls, e.call_id), "call_repeated").when(~F.coalesce(F.array_contains(approved, signature(e.tool, e.input)), F.lit(False)), "not_approved"))
                .when(result, F.when(~F.coalesce(pending & (s.open_id == e.call_id) & (s.open_tool == e.tool) & e.status.isin(RESULT_STATUS) & (e.sequence == s["last"] + 1), F.lit(False)), "result_pairing")
                      .when(e.content.isNull(), "result_content"))
                .otherwise("event_type"))
        after = F.struct(code.alias("code"), (s.n + 1).alias("at"), (s.n + 1).alias("n"), F.coalesce(e.sequence, s["last"]).alias("last"),
                         F.when(call, e.call_id).alias("open_id"), F.when(call, e.tool).alias("open_tool"),
                         F.when(call, F.array_append(s.calls, e.call_id)).otherwise(s.calls).alias("calls"), (s.results + result.cast("bigint")).alias("results"))
        return F.when(s.code.isNotNull(), s).otherwise(after)

    def finish(s: Column) -> Column:
        whole = F.when(s.open_id.isNotNull(), "open_call").when(F.size(s.calls) == 0, "no_calls")
        code = F.coalesce(s.code, whole)
        return F.struct(code.alias("code"), F.when(s.code.isNotNull(), s.at).when(whole.isNotNull(), s.n + 1).alias("at"), F.size(s.calls).cast("bigint").alias("calls"), s.results.alias("results"))

    return F.aggregate(F.coalesce(events, F.array().cast(f"array<{EVENT}>")), start, step, finish)


def audit(sessions: Column, audits: Column) -> Column:
    """struct(code, at): the first place where audits differ from the sessions that they are
    of, place by place: another number of them, revision, then digest; null if they agree.
    Both are arrays of struct(revision, digest)."""
    pairs = F.arrays_zip(sessions.alias("s"), audits.alias("a"))
    code = lambda p: F.when(~p.s.revision.eqNullSafe(p.a.revision), F.lit("revision")).when(~p.s.digest.eqNullSafe(p.a.digest), F.lit("digest"))
    broken = F.filter(F.transform(pairs, lambda p, i: F.struct(code(p).alias("code"), (i + 1).cast("bigint").alias("at"))), lambda x: x.code.isNotNull())
    count = F.coalesce(F.size(sessions), F.lit(0)) != F.coalesce(F.size(audits), F.lit(0))
    return F.when(count, F.struct(F.lit("count").alias("code"), F.lit(None).cast("bigint").alias("at"))).otherwise(F.get(broken, F.lit(0)))


def hash_chain(digests: Column) -> Column:
    """SHA-256 over the last link and the next digest, along an array; null digests count as empty."""
    return F.aggregate(digests, F.lit(""), lambda link, d: F.sha2(F.concat(link, F.coalesce(d, F.lit(""))), 256))


def holds_credential(text: Column, length: Column | int, digest: Column | str) -> Column:
    """Whether a window of length characters inside a token has this SHA-256: finds a secret
    that is known by its length and digest only."""
    length, digest = (F.lit(x) if not isinstance(x, Column) else x for x in (length, digest))
    tokens = F.filter(F.regexp_extract_all(text, F.lit(CREDENTIAL_TOKEN), F.lit(0)), lambda t: F.char_length(t) >= length)
    windows = lambda t: F.sequence(F.lit(1), F.greatest(F.char_length(t) - length + 1, F.lit(1)))
    return F.exists(tokens, lambda t: F.exists(windows(t), lambda i: F.sha2(F.substring(t, i, length), 256) == digest))


def in_workspace(text: Column, root: str) -> Column:
    """Paths under the workspace's root made relative to <workspace>."""
    return F.replace(F.replace(text, F.lit(root), F.lit("<workspace>")), F.lit(root.replace("/", "\\")), F.lit("<workspace>"))


def text_violation(text: Column, root: str, most_bytes: int, identifiers: list[str], credential: tuple[Column | int, Column | str] | None = None, public: bool = True) -> Column:
    """The first rule that a retained text breaks; null if it may stay."""
    kept = in_workspace(text, root)
    held = reduce(lambda a, b: a | b, [F.contains(F.lower(kept), F.lit(i.lower())) for i in identifiers if i], F.lit(False))
    secret = has_secret(kept) if credential is None else has_secret(kept) | holds_credential(kept, *credential)
    return (F.when(text.isNull(), F.lit("not_text")).when(text.rlike(CONTROL), F.lit("control_text")).when(F.octet_length(text) > most_bytes, F.lit("text_size"))
            .when(F.contains(text, F.lit(LOSSY_MARK)), F.lit("lossy_source")).when(secret, F.lit("secret"))
            .when(F.lit(public) & kept.rlike(HIDDEN_MARK), F.lit("hidden_reasoning")).when(kept.rlike(ABSOLUTE_PATH), F.lit("absolute_path")).when(held, F.lit("heldout")))
