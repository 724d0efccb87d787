"""The provider with three sources: a session store, exported traces, and session transcripts."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.functions import variants as v
from usagelake.functions.binding import let
from usagelake.functions.details import split_details
from usagelake.functions.evidence import CHANGED, READ, told, weighed
from usagelake.functions.ids import COUNTERS, stable_id
from usagelake.functions.paths import project_from_cwd, resolve_path
from usagelake.functions.text import UNKNOWN, first_non_empty, sorted_distinct
from usagelake.functions.times import from_parts, parse_timestamp, rfc3339_nano
from usagelake.functions.tokens import apply_total, bucket_sum, counter, usage
from usagelake.operators.dedupe import first_wins, survivor
from usagelake.operators.files import dominant_language, with_language
from usagelake.operators.precedence import suppress_lower, without_twins
from usagelake.operators.sequence import as_of, carried
from usagelake.providers.base import Provider, existing, finished, line_source, register_provider
from usagelake.providers.simple import identity
from usagelake.sources.lines import Roots, read_lines
from usagelake.sources.sqlite import read_table

TWIN_MICROS = 2_000_000


def store_tokens(details: Column, n: dict[str, Column]) -> Column:
    """Disjoint buckets: the listed details where they add up, else what was read and written is taken off the input."""
    thought = F.least(n["reasoning"], n["output"])
    fits = details.isNotNull() & (details["input_tokens"] + details["cache_read_input_tokens"] + details["cache_creation_input_tokens"] == n["input"]) & (details["output_tokens"] == n["output"])
    rest = F.greatest(n["input"] - n["read"] - n["write"], F.lit(0))
    return usage(F.when(fits, details["input_tokens"]).otherwise(rest), n["output"] - thought, F.when(fits, details["cache_creation_input_tokens"]).otherwise(n["write"]), F.when(fits, details["cache_read_input_tokens"]).otherwise(n["read"]), 0, thought)


def store_events(spark: SparkSession, dbs: list[str], contexts: DataFrame) -> DataFrame:
    sessions = read_table(spark, dbs, "sessions", ["id", "cwd", "branch"]).select("path", F.col("id").alias("session_id"), F.coalesce("cwd", F.lit("")).alias("cwd"), F.coalesce("branch", F.lit("")).alias("branch"))
    names = {"input": "input_tokens", "output": "output_tokens", "read": "cache_read_tokens", "write": "cache_write_tokens", "reasoning": "reasoning_tokens"}
    rows = read_table(spark, dbs, "assistant_usage_events", ["id", "session_id", "model", *names.values(), "token_details_json", "created_at"])
    n = {k: counter(F.coalesce(F.col(c), F.lit(""))) for k, c in names.items()}
    details = split_details(F.from_json("token_details_json", "array<struct<tokenType:string,tokenCount:bigint>>").cast("array<struct<tokenType:string,count:bigint>>"))
    tokens = store_tokens(details, n)
    day = F.trim("created_at")
    at = F.coalesce(parse_timestamp(day), F.when(day.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"), parse_timestamp(F.concat(F.replace(day, F.lit(" "), F.lit("T")), F.lit("Z")))))
    rows = rows.withColumns({"usage": apply_total(tokens, bucket_sum(tokens)), "timestamp": at}).where("timestamp is not null")
    rows = rows.join(sessions, ["path", "session_id"], "left").join(contexts, "session_id", "left")
    cwd, branch = first_non_empty(F.coalesce("cwd", F.lit("")), F.coalesce("ctx_root", F.lit("")), F.coalesce("ctx_cwd", F.lit(""))), first_non_empty(F.coalesce("branch", F.lit("")), F.coalesce("ctx_branch", F.lit("")))
    project = project_from_cwd(cwd)
    rows = rows.withColumns({"source_file": F.col("path"), "branch": branch, **identity("copilot", first_non_empty(project["project"], F.lit(UNKNOWN)), project["project_path"], F.col("session_id"), F.coalesce("model", F.lit("")), "GitHub Copilot CLI")})
    return finished(rows, id_column=stable_id(F.lit("copilot"), F.lit("store"), F.col("session_id"), F.col("id"), rfc3339_nano(F.col("timestamp"))))


#: Tools that write files, whatever their telemetry says.
WRITERS = ("write", "edit", "apply_patch", "str_replace_editor", "create")
FACT = ["session_id", "when", "at", "n", "path", "weight", "is_change", "lines_added", "lines_removed"]


def strings(at: Column, path: str) -> Column:
    """The texts of an array, or of a string that holds an array as JSON."""
    return F.filter(F.transform(listed(at, path), lambda x: v.text(x, "$")), lambda x: x != "")


def listed(at: Column, path: str) -> Column:
    inner = F.when(v.kind(at, path) == "STRING", F.try_parse_json(F.try_variant_get(at, path, "string")))
    return F.coalesce(F.try_variant_get(at, path, "array<variant>"), F.try_variant_get(inner, "$", "array<variant>"), F.array().cast("array<variant>"))


def given(at: Column, path: str) -> Column:
    """Whether an object has a value there that isn't null."""
    return F.coalesce(v.kind(at, path) != "VOID", F.lit(False))


def file_changes(cwd: Column, telemetry: Column) -> Column:
    """The files that a completed tool tells of, in the order of their names, with their lines where they can be told apart."""
    count = lambda x, c, at="$": v.count(x, f"{at}.{c}")
    named = strings(telemetry, "$.restrictedProperties.filePaths")
    added_or_gone = F.concat(strings(telemetry, "$.restrictedProperties.addedPaths"), strings(telemetry, "$.restrictedProperties.deletedPaths"))
    paths = sorted_distinct(F.when(F.size(named) > 0, named).otherwise(added_or_gone))
    measured = given(telemetry, "$.metrics.linesAdded") | given(telemetry, "$.metrics.linesRemoved")

    def changes(s: Column) -> Column:
        own = lambda i, c: F.when(F.size(s["blocks"]) == F.size(s["paths"]), count(F.get(s["blocks"], i), c)).when((F.size(s["paths"]) == 1) & measured, count(telemetry, c, "$.metrics")).otherwise(F.lit(0)).cast("long")
        return F.transform(s["paths"], lambda p, i: F.struct(p.alias("path"), own(i, "linesAdded").alias("lines_added"), own(i, "linesRemoved").alias("lines_removed")))

    return resolved(cwd, let(F.struct(paths.alias("paths"), listed(telemetry, "$.properties.codeBlocks").alias("blocks")), changes))


def resolved(cwd: Column, changes: Column) -> Column:
    """Changes with their paths seen from cwd, less those of the program's own bookkeeping."""
    kept = F.filter(changes, lambda c: ~c["path"].contains(".copilot/session-state/"))
    return F.transform(kept, lambda c: F.struct(resolve_path(cwd, c["path"]).alias("path"), c["lines_added"].alias("lines_added"), c["lines_removed"].alias("lines_removed")))


def transcripts(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of each session: its context; facts, which are file changes and paths that tell a language, with their time and weight; and the files its end
    names. A tool's completion is paired with the latest start of its call id before it, which may be all that names the tool."""
    j, order = F.col("v"), ["source_start"]
    rows = v.records(line_source(read_lines(spark, paths, r"/session-state/[^/]+/events\.jsonl$")))
    rows = rows.where(v.kind(j, "$.data").startswith("OBJECT")).withColumns({"session_id": F.regexp_extract("source_file", r"/session-state/([^/]+)/", 1), "kind": v.text(j, "$.type")})
    rows = rows.where(F.col("kind").isin("session.start", "tool.execution_start", "tool.execution_complete", "session.shutdown"))
    said = lambda c: F.when(F.col("kind") == "session.start", v.text(j, f"$.data.context.{c}")).otherwise("")
    rows = rows.withColumns({"ctx_cwd": said("cwd"), "ctx_root": said("gitRoot"), "ctx_branch": said("branch"), "when": F.coalesce(v.time(j, "$.timestamp"), F.timestamp_seconds(F.lit(0))), "call": v.text(j, "$.data.toolCallId"), "tool": v.text(j, "$.data.toolName", "$.data.name")})
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.col(c) != "", F.col("source_start"))), F.lit("")).alias(c)
    contexts = rows.where("kind = 'session.start'").groupBy("session_id").agg(*[last(c) for c in ("ctx_cwd", "ctx_root", "ctx_branch")])
    rows = rows.withColumn("cwd", carried(F.col("ctx_cwd"), ["source_file"], order))
    started = carried(F.when(F.col("kind") == "tool.execution_start", F.col("tool")).otherwise(""), ["source_file", "call"], order)
    rows = rows.withColumn("tool", F.when((F.col("tool") == "") & (F.col("call") != ""), started).otherwise(F.col("tool")))
    block = lambda p: F.when(v.kind(j, p).startswith("OBJECT"), F.try_variant_get(j, p, "variant"))
    telemetry = F.coalesce(*[block(f"$.data.{p}") for p in ("toolTelemetry", "toolResultTelemetry", "result.toolTelemetry")])
    failed = F.coalesce((v.kind(j, "$.data.success") == "BOOLEAN") & ~F.try_variant_get(j, "$.data.success", "boolean"), F.lit(False))
    done = rows.where((F.col("kind") == "tool.execution_complete") & ~failed).withColumn("t", telemetry).where("t is not null")
    t = F.col("t")
    writes = F.col("tool").isin(*WRITERS) | given(t, "$.metrics.linesAdded") | given(t, "$.metrics.linesRemoved") | (F.size(strings(t, "$.restrictedProperties.addedPaths")) > 0) | (F.size(strings(t, "$.restrictedProperties.deletedPaths")) > 0)
    base = ["session_id", "when", F.col("source_start").alias("at")]
    changes = done.where(writes).select(*base, F.posexplode(file_changes(F.col("cwd"), t)).alias("n", "c"))
    changes = changes.select("session_id", "when", "at", "n", "c.path", F.lit(CHANGED).alias("weight"), F.lit(True).alias("is_change"), "c.lines_added", "c.lines_removed")
    read = F.concat(F.array(v.text(j, "$.data.arguments.path")), F.transform(v.array(j, "$.data.arguments.paths"), lambda x: v.text(x, "$")))
    read = F.transform(F.filter(read, lambda p: p != ""), lambda p: resolve_path(F.col("cwd"), p))
    heard = F.concat(weighed(read, READ), *[told(v.text(j, f"$.data.arguments.{c}")) for c in ("command", "pattern", "query")])
    seen = rows.where("kind = 'tool.execution_start'").select(*base, F.posexplode(heard).alias("n", "e"))
    seen = seen.select("session_id", "when", "at", "n", "e.path", "e.weight", F.lit(False).alias("is_change"), F.lit(0).cast("long").alias("lines_added"), F.lit(0).cast("long").alias("lines_removed"))
    summed = "$.data.codeChanges"
    files = strings(j, f"{summed}.filesModified")
    alone = lambda c: F.when(F.size(files) == 1, v.count(j, f"{summed}.{c}")).otherwise(F.lit(0).cast("long"))
    ends = F.transform(files, lambda p: F.struct(p.alias("path"), alone("linesAdded").alias("lines_added"), alone("linesRemoved").alias("lines_removed")))
    ended = rows.where("kind = 'session.shutdown'").select(*base, F.posexplode(resolved(F.col("cwd"), ends)).alias("n", "c")).select("session_id", "at", "n", "c.*")
    # A file counts at the end only if no tool told of it.
    ended = ended.join(changes.select("session_id", "path").distinct(), ["session_id", "path"], "left_anti")
    return contexts, changes.unionByName(seen).select(*FACT), ended


def with_facts(store: DataFrame, facts: DataFrame, ended: DataFrame) -> DataFrame:
    """Store events with file changes and languages: a fact goes to the last event of its session at or before it, else to the first; what
    the session's end names to the last. An event without a known language takes the session's."""
    calls = store.select("session_id", "timestamp", F.col("id").alias("target")).withColumn("tie", F.col("target"))
    placed = as_of(facts, calls, ["session_id"], "when", "timestamp", "target", "tie", "event").where("event is not null")
    latest = store.groupBy("session_id").agg(F.max_by("id", F.struct("timestamp", "id")).alias("event"))
    changes = placed.where("is_change").select("event", F.lit(0).alias("late"), "at", "n", "path", "lines_added", "lines_removed")
    changes = changes.unionByName(ended.join(latest, "session_id").select("event", F.lit(1).alias("late"), "at", "n", "path", "lines_added", "lines_removed"))
    from usagelake.providers.stateful import with_changes

    store = with_changes(store, changes.withColumnRenamed("event", "id"), ["id"], ["late", "at", "n"], "last")
    store = with_language(store, placed.select(F.col("event").alias("id"), "path", "weight"), ["id"])
    whole = dominant_language(facts, ["session_id"]).withColumnRenamed("language", "session_language")
    store = store.join(whole, "session_id", "left")
    return store.withColumn("language", F.when(F.col("language") == UNKNOWN, F.coalesce("session_language", F.lit(UNKNOWN))).otherwise(F.col("language"))).drop("session_language")


def trace_events(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row for each call: of records about the same trace or response, those of the best kind in their file."""
    j = F.col("v")
    rows = v.records(line_source(read_lines(spark, paths, F.col("path").rlike(r"\.[jJ][sS][oO][nN][lL]$") & ~F.col("path").contains("/session-state/"), '"attributes"')))
    a = lambda *names: v.text(j, *[f"$.attributes['{x}']" for x in names])
    n = lambda *names: v.count(j, *[f"$.attributes['{x}']" for x in names])
    operation, name = a("gen_ai.operation.name"), v.text(j, "$.name", "$.attributes['event.name']", "$.body")
    span = (v.text(j, "$.type") == "span") | (v.text(j, "$.spanId", "$.spanContext.spanId") != "") & name.rlike("^(chat|invoke_agent)")
    level = F.when(span & ((operation == "chat") | name.startswith("chat")), 1).when(~span & name.contains("inference"), 2).when(~span & name.contains("agent.turn"), 3).when(span & ((operation == "invoke_agent") | name.startswith("invoke_agent")), 4)
    part = lambda p: F.when(F.size(v.array(j, p)) >= 2, from_parts(F.try_variant_get(j, p + "[0]", "long"), F.try_variant_get(j, p + "[1]", "long")))
    at = F.coalesce(*[F.coalesce(part(f"$.{p}"), v.time(j, f"$.{p}")) for p in ("endTime", "startTime", "hrTime", "_hrTime", "time", "timestamp", "observedTimestamp", "timeUnixNano")], F.col("mtime"))
    read = n("gen_ai.usage.cache_read.input_tokens", "gen_ai.usage.cache_read_input_tokens")
    written = n("gen_ai.usage.cache_creation.input_tokens", "gen_ai.usage.cache_write.input_tokens", "gen_ai.usage.cache_creation_input_tokens")
    tokens = usage(F.greatest(n("gen_ai.usage.input_tokens") - read, F.lit(0)), n("gen_ai.usage.output_tokens"), written, read, 0, n("gen_ai.usage.reasoning.output_tokens", "gen_ai.usage.reasoning_tokens", "gen_ai.usage.reasoning_output_tokens"))
    rows = rows.withColumns({"level": level, "trace_id": v.text(j, "$.traceId", "$.spanContext.traceId"), "response_id": a("gen_ai.response.id"), "timestamp": at, "usage": apply_total(tokens, F.lit(0)), "said_model": a("gen_ai.response.model", "gen_ai.request.model"), "said_session": a("gen_ai.conversation.id", "session.id", "copilot_chat.session_id")})
    named = rows.where("trace_id <> ''")
    model = survivor(named.where("said_model <> ''"), ["source_file", "trace_id"], [F.asc("source_start")]).select("source_file", "trace_id", F.col("said_model").alias("trace_model"))
    session = survivor(named.where("said_session <> ''"), ["source_file", "trace_id"], [F.asc_nulls_last("level"), F.asc("source_start")]).select("source_file", "trace_id", F.col("said_session").alias("trace_session"))
    rows = rows.where("level is not null").join(model, ["source_file", "trace_id"], "left").join(session, ["source_file", "trace_id"], "left")
    rows = suppress_lower(rows, ["source_file"], ["trace_id", "response_id"], "level")
    rows = rows.withColumns(identity("copilot", "copilot", "GitHub Copilot", first_non_empty(F.col("said_session"), F.coalesce("trace_session", F.lit("")), F.col("trace_id"), F.lit("unknown-session")), first_non_empty(F.col("said_model"), F.coalesce("trace_model", F.lit("")), F.lit("unknown")), "GitHub Copilot"))
    key = F.when(F.col("response_id") != "", F.concat(F.lit("response:"), F.col("response_id"))).otherwise(F.concat_ws(":", F.col("trace_id"), v.text(j, "$.spanId", "$.spanContext.spanId"), rfc3339_nano(F.col("timestamp"))))
    return first_wins(finished(rows, id_column=stable_id(F.lit("copilot"), F.lit("otel"), F.col("session_id"), key)), ["id"], ["source_file", "source_start"])


def load_copilot(spark: SparkSession, paths: list[str]) -> DataFrame:
    # A database that is named itself has no lines; there can be thousands of them.
    texts = Roots([p for p in paths if not (p.lower().endswith(".db") and os.path.isfile(p))], getattr(paths, "only", None))
    contexts, facts, ended = transcripts(spark, texts)
    store = with_facts(store_events(spark, existing(paths, "session-store.db"), contexts), facts, ended)
    from usagelake.schema import as_events

    store = as_events(store)
    keys = ["session_id", "model", *[c for c in COUNTERS if c not in ("cached_input_tokens", "total_tokens")]]
    flat = lambda d: d.select("*", *[F.col(f"usage.{c}").alias(c) for c in keys[2:]])
    traces = without_twins(flat(trace_events(spark, texts)), flat(store), keys, "timestamp", TWIN_MICROS).drop(*keys[2:])
    return store.unionByName(traces)


register_provider(Provider("copilot", load_copilot))
