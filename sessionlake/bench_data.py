"""Deterministic benchmark sessions: ids, working directories, topics and six events each, as expressions over a range."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

TOPICS = ("deployment", "sqlite", "parser", "reconstruction")
BASE_S, STEP_S, PROJECTS = 1_767_225_600, 60, 100
BENCH_QUERIES = ("deployment benchmark", "sqlite migration", "parser regression")


def generated_sessions(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("i")
    topics = F.array(*[F.lit(t) for t in TOPICS])
    return spark.range(n).withColumnRenamed("id", "i").select(
        "i", F.format_string("bench-%06d", i).alias("id"), F.format_string("/workspace/project-%03d", i % PROJECTS).alias("cwd"),
        F.get(topics, i % len(TOPICS)).alias("topic"), ((F.lit(BASE_S) + STEP_S * i) * 1000).alias("started_at_ms"), (i < -(-n // 100)).alias("changed"),
    )


def generated_archive(spark: SparkSession, n: int, changed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sessions, events): six events a session; a changed session has one more answer."""
    s = generated_sessions(spark, n)
    null = lambda t: F.lit(None).cast(t)
    rows = s.select(
        F.concat(F.lit("codex:"), F.col("id")).alias("id"), F.lit("codex").alias("agent"), "cwd", "started_at_ms", (F.col("started_at_ms") + 8000).alias("ended_at_ms"),
        F.concat(F.col("topic"), F.lit(" benchmark")).alias("title"), F.lit("bench-model").alias("model"), F.lit("bench").alias("provider"), null("string").alias("git_branch"),
        null("string").alias("parent_session_id"), null("string").alias("forked_from"), F.lit("full").alias("mode"), F.concat(F.lit("f:"), F.col("id")).alias("fingerprint"), F.lit("{}").alias("meta_json"), F.col("started_at_ms").alias("ingested_at_ms"),
    )
    t = F.col("topic")
    steps = [
        ("user", F.concat(F.lit("please check the "), t, F.lit(" benchmark and its migration "), F.col("i").cast("string"))),
        ("thinking", F.concat(F.lit("looking for a regression in "), t)),
        ("tool_call", F.concat(F.lit('{"command":"run '), t, F.lit('"}'))),
        ("tool_result", F.concat(F.lit("ran "), t)),
        ("assistant", F.concat(F.lit("the "), t, F.lit(" run is done"))),
        ("usage", F.lit("{}")),
    ]
    extra = [("assistant", F.concat(F.lit("changed answer on "), t))] if changed else []
    each = F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(kind).alias("kind"), text.alias("text")) for k, (kind, text) in enumerate(steps + extra)])
    kept = F.filter(each, lambda x: (x["idx"] < len(steps)) | F.col("changed"))
    ev = s.select(F.concat(F.lit("codex:"), F.col("id")).alias("session_id"), "started_at_ms", F.explode(kept).alias("e"))
    return rows, ev.select("session_id", F.col("e.idx").cast("long").alias("idx"), "e.kind", "e.text", F.col("started_at_ms").alias("created_at_ms"))


def native_records(i: int, topic: str, cwd: str, started_ms: int, changed: bool) -> list[dict]:
    """The lines of one session's file: six events, and one more answer where it is changed."""

    def at(s: int) -> str:
        from datetime import datetime, timezone

        return datetime.fromtimestamp(started_ms // 1000 + s, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    item = lambda s, **p: {"type": "response_item", "timestamp": at(s), "payload": p}
    told = lambda s, **p: {"type": "event_msg", "timestamp": at(s), "payload": p}
    records = [
        {"type": "session_meta", "timestamp": at(0), "payload": {"id": f"bench-{i:06d}", "cwd": cwd, "model_provider": "bench"}},
        {"type": "turn_context", "payload": {"model": "bench-model"}},
        told(1, type="user_message", message=f"please check the {topic} benchmark and its migration {i}"),
        item(2, type="reasoning", summary=f"looking for a regression in {topic}"),
        item(3, type="function_call", name="shell", call_id="c", arguments=json.dumps({"command": f"run {topic}"})),
        item(4, type="function_call_output", call_id="c", output=f"ran {topic}. " + "All steps passed without a warning. " * 12),
        item(6, type="message", role="assistant", content=[{"type": "output_text", "text": f"the {topic} run is done"}]),
        told(8, type="token_count", info={"last_token_usage": {"total_tokens": 100 + i % 50}}),
    ]
    return records + [item(9, type="message", role="assistant", content=[{"type": "output_text", "text": f"changed answer on {topic}"}])] * changed


def write_native(spark: SparkSession, n: int, folder: str, changed: bool = False) -> None:
    """A file for each generated session, a thousand to a folder; ``changed`` writes the first hundredth again."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for r in b.itertuples():
                place = f"{folder}/{r.i // 1000:04d}"
                os.makedirs(place, exist_ok=True)
                with open(f"{place}/rollout-{r.id}.jsonl", "w") as f:
                    f.writelines(json.dumps(x) + "\n" for x in native_records(r.i, r.topic, r.cwd, r.started_at_ms, changed))
            yield pd.DataFrame({"n": [len(b)]})

    s = generated_sessions(spark, n)
    (s.filter("changed") if changed else s).mapInPandas(run, "n long").agg(F.sum("n")).collect()
