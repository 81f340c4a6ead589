"""Object notifications: parsing, gating and idempotent ingest, in batch and as a stream; sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T

ENVELOPE = "message struct<attributes:map<string,string>,messageId:string>"


def parse_envelope(body: Column) -> dict[str, Column]:
    """Columns bucket, object_id, generation, event_type and problem of a push envelope (JSON text)."""
    doc = F.from_json(body, ENVELOPE)
    attr = lambda k: F.element_at(doc["message"]["attributes"], k)
    text = lambda c: F.coalesce(c, F.lit(""))
    problem = F.when(doc.isNull() | doc["message"].isNull(), "missing message").when((text(attr("bucketId")) == "") | (text(attr("objectId")) == ""), "missing bucketId or objectId")
    return {"bucket": attr("bucketId"), "object_id": attr("objectId"), "generation": attr("objectGeneration"), "event_type": attr("eventType"), "problem": problem}


def gate(events: DataFrame, body_col: str = "body") -> DataFrame:
    """Events with the parsed columns, ``kind``, ``doc_id`` and ``status``.

    rejected: broken envelopes and kinds that can't be read; ignored: event types other than the final one; else accepted.
    """
    cols = parse_envelope(F.col(body_col))
    parsed = events.withColumns(cols)
    kind = T.object_kind(F.col("object_id"))
    status = F.when(F.col("problem").isNotNull(), "rejected").when((F.coalesce("event_type", F.lit("")) != "") & (F.col("event_type") != "OBJECT_FINALIZE"), "ignored").when(kind != "pdf", "rejected").otherwise("accepted")
    return parsed.withColumn("kind", F.when(F.col("problem").isNull(), kind)).withColumn("doc_id", F.when(F.col("problem").isNull(), T.path_stem(F.col("object_id")))).withColumn("status", status)


def latest_generation(accepted: DataFrame) -> DataFrame:
    """One accepted event per document: the one of the highest generation."""
    last = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last(F.col("generation").try_cast("bigint")), F.desc_nulls_last("object_id"))
    return accepted.where("status = 'accepted'").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def run_gate(spark: SparkSession, source: str, checkpoint: str, handle: Callable[[DataFrame, int], None], quarantine: str | None = None):
    """A stream over JSON-lines files (column ``body``) that hands each batch's documents, the last event of each, to ``handle``.

    ``handle`` must be idempotent, as a batch may be delivered again. Rejected events go to ``quarantine``.
    """
    events = spark.readStream.schema("body string").json(source)

    def each(batch: DataFrame, batch_id: int) -> None:
        gated = gate(batch)
        if quarantine:
            gated.where("status = 'rejected'").select("body", "problem", "kind").write.mode("overwrite").json(f"{quarantine}/batch={batch_id}")
        handle(latest_generation(gated), batch_id)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def get_or_create_sessions(sessions: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("app", "user_id", "session_id")) -> DataFrame:
    """All sessions with those wanted that didn't exist yet."""
    new = wanted.select(*keys).distinct().join(sessions, list(keys), "left_anti")
    return sessions.unionByName(new, allowMissingColumns=True)


def reset_sessions(sessions: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ("app", "user_id", "session_id")) -> DataFrame:
    """Sessions with those wanted deleted if present and created anew, without their state."""
    kept = sessions.join(wanted.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(wanted.select(*keys).distinct(), allowMissingColumns=True)


def final_responses(turns: DataFrame) -> DataFrame:
    """(session_id, response): the text of each session's last final turn (session_id, turn, is_final, parts), parts line by line."""
    text = F.array_join(F.filter("parts", lambda p: F.coalesce(p, F.lit("")) != ""), "\n")
    return turns.where("is_final").withColumn("text", text).where("text <> ''").groupBy("session_id").agg(F.max_by("text", "turn").alias("response"))


def chat_turns(requests: DataFrame, sessions: DataFrame, answer: Callable[[Column], Column], keys: tuple[str, ...] = ("app", "user_id", "session_id")) -> tuple[DataFrame, DataFrame]:
    """(turns, sessions): requests (keys, turn, message) with ``response`` and ``problem``, and the sessions with those that are new.

    A blank message is refused before anything else and makes no session. ``answer`` gives the reply as a Column of the message
    (any model behind a Pandas or Arrow UDF); a blank reply is a problem, and the session stays.
    """
    blank = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    asked = requests.withColumn("_ok", ~blank(F.col("message")))
    replied = asked.withColumn("response", F.when(F.col("_ok"), answer(F.col("message"))))
    problem = F.when(~F.col("_ok"), "blank message").when(blank(F.col("response")), "empty answer")
    turns = replied.withColumn("problem", problem).withColumn("response", F.when(problem.isNull(), F.col("response"))).drop("_ok")
    return turns, get_or_create_sessions(sessions, asked.where("_ok"), keys)
