"""Judging pieces with a pluggable backend; findings are kept for target lines only, and every call becomes a ledger row."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Backend = Callable[[str, str], dict]
#: level: model, effort and spending limit
LEVELS = {"max": ("large", "high", 2.0), "balanced": ("large", "low", 0.8), "min": ("small", "low", 0.8)}

CALL = "doc_key string, first int, last int, ok boolean, reason string, cost_usd double, findings array<struct<line_no:int,phrase:string,fix:string,why:string,category:string>>, malformed int"


def recovered(text: str):
    """JSON of a reply: as it is, from a fence, or between the outermost brackets; None if there is none."""
    tries = [text, *re.findall(r"```(?:json)?\s*(.*?)```", text, re.S)]
    for a, b in ("[]", "{}"):
        if a in text and b in text:
            tries.append(text[text.index(a) : text.rindex(b) + 1])
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


def parsed_rows(reply) -> tuple[list[tuple], int]:
    """Findings of a reply, and how many rows were malformed."""
    rows, bad = [], 0
    for r in reply if isinstance(reply, list) else []:
        if isinstance(r, dict) and isinstance(r.get("line"), int) and r.get("phrase"):
            rows.append((r["line"], str(r["phrase"]), str(r.get("fix", "")), str(r.get("why", "")), str(r.get("category", ""))))
        else:
            bad += 1
    return rows, bad


def judge(pieces: DataFrame, backend: Backend, system: str) -> DataFrame:
    """One call for each piece (doc_key, first, last, text)."""

    def called(frames):
        for frame in frames:
            out = []
            for p in frame.itertuples(index=False):
                answer = backend(system, p.text)
                reply = recovered(answer.get("text", ""))
                rows, bad = parsed_rows(reply)
                ok = reply is not None and answer.get("stop_reason") != "max_tokens"
                out.append((p.doc_key, p.first, p.last, ok, "" if ok else answer.get("stop_reason") or "no JSON", float(answer.get("cost_usd", 0.0)), rows, bad))
            yield pd.DataFrame(out, columns=["doc_key", "first", "last", "ok", "reason", "cost_usd", "findings", "malformed"])

    return pieces.select(F.col("doc_key").cast("string").alias("doc_key"), "first", "last", "text").mapInPandas(called, CALL)


def target_findings(calls: DataFrame, targets: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings on target lines with Hangul, and the numbers of hidden (no target) and foreign (no Hangul) ones by document."""
    each = calls.where("ok").select("doc_key", F.inline("findings"))
    marked = each.join(targets.select("doc_key", "line_no", F.lit(True).alias("target")).distinct(), ["doc_key", "line_no"], "left").join(lines.select("doc_key", "line_no", "text"), ["doc_key", "line_no"], "left")
    marked = marked.withColumn("foreign", ~F.coalesce(F.col("text").rlike("[가-힣]"), F.lit(False))).withColumn("hidden", F.col("target").isNull())
    counts = marked.groupBy("doc_key").agg(F.count_if("hidden").alias("hidden"), F.count_if(~F.col("hidden") & F.col("foreign")).alias("foreign"))
    return marked.where("NOT hidden AND NOT foreign").select(*each.columns), counts


def judge_all(pieces: DataFrame, backend: Backend, system: str, again: Callable[[DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """Calls for all pieces; those that fail are cut by ``again`` and called anew, at most ``rounds`` times."""
    done, left = None, pieces
    for _ in range(rounds):
        calls = judge(left, backend, system).persist()
        good = calls.where("ok")
        done = good if done is None else done.union(good)
        failed = calls.where("NOT ok").select("doc_key", "first", "last")
        if failed.isEmpty():
            return done
        left = again(failed)
    return done.union(calls.where("NOT ok"))


def ledger_rows(calls: DataFrame, targets: DataFrame, when: float) -> DataFrame:
    """Rows to append: what each call has seen, asked and cost."""
    seen = targets.join(calls.where("ok").select("doc_key", "first", "last"), "doc_key").where("line_no BETWEEN first AND last").groupBy("doc_key", "first").agg(F.array_sort(F.collect_set("line_key")).alias("seen"))
    return calls.join(seen, ["doc_key", "first"], "left").select(F.lit(when).alias("when"), "doc_key", "ok", "cost_usd", "seen", F.col("findings").alias("fixes"))
