"""Conversation state: sessions that expire when idle, and the turns that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom import settings as S


def last_turns(turns: DataFrame, n: int, session: str = "session_id", order: str = "turn") -> DataFrame:
    """The last ``n`` turns of each session.

    Spark keeps ``n`` rows per session before it shuffles, so a long session costs no more
    than a short one.
    """
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return turns.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def rewrite_history(turns: DataFrame, session: str = "session_id") -> DataFrame:
    """Turns shown to a follow-up question: the last three, answers cut short."""
    recent = last_turns(turns, S.REWRITE_TURNS, session)
    return recent.withColumn("answer", F.substring("answer", 1, S.REWRITE_ANSWER_CHARS))


def usable_history(turns: DataFrame, session: str = "session_id") -> DataFrame:
    """Answered turns whose sources are all available, answers cut, the last six.

    Turns: session, ``turn, question, answer, status, unavailable_sources bigint``.
    """
    answer = F.regexp_replace(F.substring("answer", 1, S.HISTORY_ANSWER_CHARS), r"(?U)^\s+|\s+$", "")
    question = F.trim("question")
    good = (
        (F.col("status") == S.ANSWERED) & (F.col("unavailable_sources") == 0)
        & (question != "") & ~question.contains("\0") & (F.length(question) <= S.MAX_QUESTION_CHARS)
    )
    kept = turns.filter(good).withColumns({"question": question, "answer": answer})
    return last_turns(kept.filter((F.col("answer") != "") & ~F.col("answer").contains("\0")), S.HISTORY_TURNS, session)


def expire_sessions(
    events: DataFrame, key: str, ts: str, ttl_seconds: int = S.SESSION_TTL_SECONDS, slice_seconds: int = 86_400
) -> DataFrame:
    """Sessions per key: a gap longer than the TTL starts a new one.

    Output: (key, session, events, started, ended). Rows are first joined into fragments
    inside one key and time slice, then fragments into sessions. Fragments of a key are
    separated by a gap or a slice border, so their number follows from the time covered
    and not from the rows: a key that holds a third of all rows is spread over its slices.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    ttl = ttl_seconds * 1_000_000
    rows = events.select(
        F.col(key), micros.alias("at"), F.floor(micros / F.lit(slice_seconds * 1_000_000)).alias("slice")
    )
    inside = Window.partitionBy(key, "slice").orderBy("at")
    opens = lambda before, at, w: F.coalesce(F.col(at) - F.lag(before).over(w) > ttl, F.lit(True)).cast("int")
    running = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    fragments = (
        rows.withColumn("_new", opens("at", "at", inside))
        .withColumn("_fragment", F.sum("_new").over(running(inside)))
        .groupBy(key, "slice", "_fragment")
        .agg(F.count(F.lit(1)).alias("events"), F.min("at").alias("started"), F.max("at").alias("ended"))
    )
    whole = Window.partitionBy(key).orderBy("started")
    return (
        fragments.withColumn("_new", opens("ended", "started", whole))
        .withColumn("session", F.sum("_new").over(running(whole)).cast("bigint"))
        .groupBy(key, "session")
        .agg(F.sum("events").alias("events"), F.min("started").alias("started"), F.max("ended").alias("ended"))
    )
