"""Providers whose records stand for themselves: one line, document or row is one event at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelake.functions import variants as v
from usagelake.functions.binding import let
from usagelake.functions.paths import base
from usagelake.functions.text import first_non_empty
from usagelake.functions.times import from_float, parse_timestamp
from usagelake.functions.tokens import apply_total, bucket_sum, counter, first_positive, usage
from usagelake.operators.dedupe import first_wins, last_wins
from usagelake.operators.sequence import carried
from usagelake.providers.base import Provider, existing, finished, line_source, path_parts, register_provider
from usagelake.sources.lines import read_documents, read_lines
from usagelake.sources.sqlite import read_table


def identity(provider: str, project: Column | str, project_path: Column | str, session: Column, model: Column, client: str) -> dict[str, Column]:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return {"provider": F.lit(provider), "project": lit(project), "project_path": lit(project_path), "session_id": session, "model": model, "client": F.lit(client)}


def parsed_lines(lines: DataFrame) -> DataFrame:
    return v.records(line_source(lines))


def has(path: str) -> Column:
    return v.kind(F.col("v"), path).startswith("OBJECT")


def stem(path: Column) -> Column:
    return F.regexp_replace(base(path), r"\.[^.]*$", "")


def after(parts: Column, name: str, offset: int = 1) -> Column:
    """The path part `offset` places after the first part called name; null if there is none."""
    return let(parts, lambda p: let(F.array_position(p, name), lambda at: F.when(at > 0, F.try_element_at(p, (at + offset).cast("int")))))


# qwen
def qwen_lines(lines: DataFrame) -> DataFrame:
    j, path = F.col("v"), F.col("source_file")
    rows = parsed_lines(lines).where((v.text(j, "$.type") == "assistant") & has("$.usageMetadata"))
    project = F.coalesce(F.nullif(F.regexp_extract(path, r"/projects/([^/]+)/chats/", 1), F.lit("")), F.lit("Unknown"))
    tokens = usage(v.count(j, "$.usageMetadata.promptTokenCount"), v.count(j, "$.usageMetadata.candidatesTokenCount"), 0, v.count(j, "$.usageMetadata.cachedContentTokenCount"), 0, v.count(j, "$.usageMetadata.thoughtsTokenCount"))
    session = first_non_empty(v.text(j, "$.sessionId"), F.concat(project, F.lit("-"), stem(path)))
    rows = rows.withColumns({"timestamp": F.coalesce(v.time(j, "$.timestamp"), F.col("mtime")), "tokens": tokens, **identity("qwen", "qwen", project, session, first_non_empty(v.text(j, "$.model"), F.lit("unknown")), "Qwen")})
    return finished(rows.withColumn("usage", apply_total(F.col("tokens"), v.count(j, "$.usageMetadata.totalTokenCount"))))


QWEN = r"/projects/[^/]+/chats/.*\.[jJ][sS][oO][nN][lL]$"
register_provider(Provider("qwen", lambda s, p: qwen_lines(read_lines(s, p, QWEN, '"usageMetadata"')), ('"usageMetadata"',), qwen_lines))


# pi
def pi_lines(lines: DataFrame) -> DataFrame:
    j, path = F.col("v"), F.col("source_file")
    rows = parsed_lines(lines).where(v.text(j, "$.type").isin("", "message") & (v.text(j, "$.message.role") == "assistant") & has("$.message.usage"))
    name = stem(path)
    session = F.when(name.rlike("^[^_]+_.+"), F.regexp_extract(name, "^[^_]+_(.+)$", 1)).when(name == "", "unknown").otherwise(name)
    project = F.coalesce(after(path_parts(path), "sessions"), F.lit("Unknown"))
    model = v.text(j, "$.message.model")
    tokens = usage(*[v.count(j, f"$.message.usage.{c}") for c in ("input", "output", "cacheWrite", "cacheRead")])
    rows = rows.withColumns({"timestamp": v.time(j, "$.timestamp"), "tokens": tokens, **identity("pi", project, project, session, F.when(model != "", F.concat(F.lit("[pi] "), model)).otherwise(""), "pi-agent")})
    return finished(rows.where("timestamp is not null").withColumn("usage", apply_total(F.col("tokens"), v.count(j, "$.message.usage.totalTokens"))))


register_provider(Provider("pi", lambda s, p: pi_lines(read_lines(s, p, r"\.[jJ][sS][oO][nN][lL]$", '"usage"', '"message"')), ('"usage"', '"message"'), pi_lines))


# kimi
KIMI = r"/sessions/[^/]+/[^/]+/(?:[^/]+/[^/]+/)?wire\.jsonl$"


def kimi_lines(lines: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Two dialects; models: root, model of each data folder's configuration."""
    j, path = F.col("v"), F.col("source_file")
    turn = v.text(j, "$.type") == "usage.record"
    new = turn & (v.text(j, "$.usageScope") == "turn") & has("$.usage")
    old = ~turn & (v.text(j, "$.message.type") == "StatusUpdate") & has("$.message.payload.token_usage")
    at = "$.message.payload.token_usage."
    buckets = usage(*[F.when(turn, v.count(j, f"$.usage.{a}")).otherwise(v.count(j, at + b)) for a, b in (("inputOther", "input_other"), ("output", "output"), ("inputCacheCreation", "input_cache_creation"), ("inputCacheRead", "input_cache_read"))])
    folder = F.regexp_replace(path, "/wire\\.jsonl$", "")
    session = base(F.regexp_replace(folder, "/agents/[^/]+$", ""))
    rows = parsed_lines(lines).where(new | old).withColumn("root", F.regexp_extract(path, "^(.*)/sessions/", 1))
    rows = rows.join(F.broadcast(models), "root", "left") if models is not None else rows.withColumn("config_model", F.lit(None).cast("string"))
    own = F.when(turn, F.regexp_replace(v.text(j, "$.model"), "^kimi-code/", "")).otherwise("")
    rows = rows.withColumns({"timestamp": F.coalesce(F.when(turn, v.time(j, "$.time")).otherwise(v.time(j, "$.timestamp")), F.col("mtime")), "tokens": buckets, "message_id": F.when(turn, F.lit("")).otherwise(v.text(j, "$.message.payload.message_id")), **identity("kimi", "kimi", "Kimi", session, first_non_empty(own, F.coalesce("config_model", F.lit("")), F.lit("kimi-for-coding")), "Kimi")})
    return finished(rows.withColumn("usage", apply_total(F.col("tokens"), F.when(turn, 0).otherwise(v.count(j, at + "total")))), F.col("message_id"))


def load_kimi(spark: SparkSession, paths: list[str]) -> DataFrame:
    # One small file for each data folder; its size is bounded by the number of paths given.
    config = read_documents(spark, paths, r"/config\.json$").select(F.regexp_replace("path", "/config\\.json$", "").alias("root"), v.text(F.try_parse_json("value"), "$.model").alias("config_model"))
    return first_wins(kimi_lines(read_lines(spark, paths, KIMI, "usage"), config), ["id"], ["source_file", "source_start"])


register_provider(Provider("kimi", load_kimi, ("usage",), kimi_lines))


# openclaw
def load_openclaw(spark: SparkSession, paths: list[str]) -> DataFrame:
    j, path = F.col("v"), F.col("source_file")
    rows = parsed_lines(read_lines(spark, paths, r"/[^/]*\.jsonl(\.deleted\.[^/]*|\.reset\.[^/]*)?$"))
    change = (v.text(j, "$.type") == "model_change") | ((v.text(j, "$.type") == "custom") & (v.text(j, "$.customType") == "model-snapshot"))
    within = has("$.data")
    rows = rows.withColumn("change", change)
    changed = lambda *names: F.when(F.col("change"), F.when(within, v.text(j, *[f"$.data.{n}" for n in names])).otherwise(v.text(j, *[f"$.{n}" for n in names]))).otherwise("")
    keys, order = ["source_file"], ["source_start"]
    said = ~F.col("change") & (v.text(j, "$.type") == "message") & (v.text(j, "$.message.role") == "assistant") & has("$.message.usage")
    tokens = usage(*[v.count(j, f"$.message.usage.{c}") for c in ("input", "output", "cacheWrite", "cacheRead")])
    # All that a record says is read before files are put in order, whose tasks get a few columns of lines that count.
    rows = rows.withColumns({"now_model": changed("modelId", "model"), "now_provider": changed("provider"), "said": said})
    rows = rows.where("change or said").withColumns({"timestamp": F.coalesce(v.time(j, "$.message.timestamp"), v.time(j, "$.timestamp"), F.col("mtime")), "own_model": v.text(j, "$.message.modelId", "$.message.model"), "own_provider": v.text(j, "$.message.provider"), "usage": apply_total(tokens, v.count(j, "$.message.usage.totalTokens"))})
    rows = rows.drop("v", "value", "mtime").withColumns({"now_model": carried(F.col("now_model"), keys, order), "now_provider": carried(F.col("now_provider"), keys, order)}).where("said")
    name = base(path)
    session = F.when(F.instr(name, ".jsonl") > 1, F.substring_index(name, ".jsonl", 1)).otherwise(name)
    model = first_non_empty(F.col("own_model"), F.col("now_model"), F.lit("unknown"))
    rows = rows.withColumns(identity("openclaw", "openclaw", "OpenClaw", session, F.concat(F.lit("[openclaw] "), model), "OpenClaw"))
    return finished(rows, first_non_empty(F.col("own_provider"), F.col("now_provider")))


register_provider(Provider("openclaw", load_openclaw))


# amp
def load_amp(spark: SparkSession, paths: list[str]) -> DataFrame:
    docs = read_documents(spark, paths, r"/threads/.*\.[jJ][sS][oO][nN]$").withColumn("v", v.parsed(F.col("value"))).withColumn("thread", v.text(F.col("v"), "$.id")).where("thread <> ''")
    docs = docs.select("path", "thread", v.array(F.col("v"), "$.messages").alias("messages"), v.array(F.col("v"), "$.usageLedger.events").alias("events"))
    j = F.col("v")
    messages = docs.select("path", "thread", F.size("events").alias("n_events"), F.posexplode("messages").alias("at", "v"))
    whole = lambda c: F.coalesce(v.text(j, c).try_cast("long"), F.lit(0))
    cache = messages.where(v.text(j, "$.role") == "assistant").select("path", whole("$.messageId").alias("message"), "at", v.count(j, "$.usage.cacheCreationInputTokens").alias("made"), v.count(j, "$.usage.cacheReadInputTokens").alias("read")).where("message <> 0")
    cache = last_wins(cache, ["path", "message"], ["at"]).select("path", "message", "made", "read")
    ledger = docs.select("path", "thread", F.posexplode("events").alias("at", "v")).withColumn("message", whole("$.toMessageId")).where(has("$.tokens"))
    ledger = ledger.join(cache, ["path", "message"], "left").select("path", "thread", "at", v.time(j, "$.timestamp").alias("timestamp"), v.text(j, "$.model").alias("m"), v.text(j, "$.id").alias("own_id"), usage(v.count(j, "$.tokens.input"), v.count(j, "$.tokens.output"), F.coalesce("made", F.lit(0)), F.coalesce("read", F.lit(0))).alias("tokens"), v.count(j, "$.tokens.total").alias("all"))
    plain = messages.where((F.col("n_events") == 0) & (v.text(j, "$.role") == "assistant") & has("$.usage"))
    plain = plain.select("path", "thread", "at", F.coalesce(v.time(j, "$.usage.timestamp"), v.time(j, "$.timestamp")).alias("timestamp"), v.text(j, "$.usage.model", "$.model").alias("m"), v.text(j, "$.messageId").alias("own_id"), usage(*[v.count(j, f"$.usage.{c}") for c in ("inputTokens", "outputTokens", "cacheCreationInputTokens", "cacheReadInputTokens")]).alias("tokens"), v.count(j, "$.usage.totalTokens").alias("all"))
    rows = ledger.unionByName(plain).where("timestamp is not null and m <> ''")
    rows = rows.withColumns({"source_file": F.col("path"), "source_line": (F.col("at") + 1).cast("int"), "usage": apply_total(F.col("tokens"), F.col("all")), **identity("amp", "amp", "Amp", F.col("thread"), F.col("m"), "Amp")})
    return finished(rows, F.col("own_id"))


register_provider(Provider("amp", load_amp))


# droid
def droid_model(model: Column) -> Column:
    """Lower case, without a custom: prefix and bracketed parts, runs of separators as one dash."""
    bare = F.trim(F.regexp_replace(model, "^custom:", ""))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))
    kept = F.aggregate(F.split(bare, ""), start, lambda a, c: F.struct(F.when(c == "[", a["depth"] + 1).when((c == "]") & (a["depth"] > 0), a["depth"] - 1).otherwise(a["depth"]).alias("depth"), F.when((a["depth"] == 0) & ~c.isin("[", "]"), F.concat(a["out"], c)).otherwise(a["out"]).alias("out")))["out"]
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(kept)), r"[._\s-]+", "-"), "^-+|-+$", "")


# Provider names and the models that stand for them.
DROID_PROVIDERS = {"claude": "anthropic", "anthropic": "anthropic", "google": "google", "google_ai": "google", "gemini": "google", "vertex": "google", "vertex_ai": "google", "xai": "xai", "x_ai": "xai", "grok": "xai"}
DROID_MODELS = {"anthropic": "claude-unknown", "openai": "gpt-unknown", "google": "gemini-unknown", "xai": "grok-unknown"}


def mapped(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def load_droid(spark: SparkSession, paths: list[str]) -> DataFrame:
    j = F.col("v")
    docs = read_documents(spark, paths, r"\.settings\.json$").withColumn("v", v.parsed(F.col("value"))).where(has("$.tokenUsage")).withColumn("beside", F.regexp_replace("path", r"\.settings\.json$", ".jsonl"))
    lines = read_lines(spark, paths, r"\.jsonl$", "Model:").where("line <= 500")
    said = droid_model(F.trim(F.regexp_extract("value", r'Model:["\\\[]*([^"\\\[]*)', 1)))
    side = first_wins(lines.select(F.col("path").alias("beside"), "line", said.alias("side_model")).where("side_model <> ''"), ["beside"], ["line"]).drop("line")
    name = F.replace(F.lower(v.text(j, "$.providerLock")), F.lit("-"), F.lit("_"))
    provider = F.when(name == "", "unknown").otherwise(F.coalesce(mapped(DROID_PROVIDERS, name), name))
    tokens = usage(*[v.count(j, f"$.tokenUsage.{c}") for c in ("inputTokens", "outputTokens", "cacheCreationTokens", "cacheReadTokens")], 0, v.count(j, "$.tokenUsage.thinkingTokens"))
    session = first_non_empty(F.regexp_replace(base(F.col("path")), r"\.settings\.json$", ""), F.lit("unknown"))
    rows = docs.join(side, "beside", "left").withColumns({"timestamp": F.coalesce(v.time(j, "$.providerLockTimestamp"), F.col("mtime")), "source_file": F.col("path"), "source_line": F.lit(1), "usage": apply_total(tokens, v.count(j, "$.tokenUsage.totalTokens")), **identity("droid", "droid", "Droid", session, first_non_empty(droid_model(v.text(j, "$.model")), F.coalesce("side_model", F.lit("")), F.coalesce(mapped(DROID_MODELS, provider), F.lit("unknown"))), "Droid")})
    return finished(rows, F.col("session_id"))


register_provider(Provider("droid", load_droid))


# hermes
def load_hermes(spark: SparkSession, paths: list[str]) -> DataFrame:
    columns = ["id", "model", "started_at", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]
    rows = read_table(spark, existing(paths, "state.db"), "sessions", columns, "model IS NOT NULL AND TRIM(model) != ''").where("coalesce(id, '') <> ''")
    n = lambda c: counter(F.coalesce(F.col(c), F.lit("")))
    tokens = usage(n("input_tokens"), n("output_tokens"), n("cache_write_tokens"), n("cache_read_tokens"), 0, n("reasoning_tokens"))
    rows = rows.withColumns({"source_file": F.col("path"), "timestamp": F.coalesce(parse_timestamp(F.col("started_at")), from_float(F.col("started_at").try_cast("double"))), "usage": apply_total(tokens, bucket_sum(tokens)), **identity("hermes", "hermes", "Hermes", F.trim("id"), F.trim("model"), "Hermes Agent")})
    return finished(rows.where("timestamp is not null"), F.concat(F.lit("hermes:"), F.col("session_id")))


register_provider(Provider("hermes", load_hermes))


# goose
def load_goose(spark: SparkSession, paths: list[str]) -> DataFrame:
    columns = ["id", "model_config_json", "provider_name", "created_at", "total_tokens", "input_tokens", "output_tokens", "accumulated_total_tokens", "accumulated_input_tokens", "accumulated_output_tokens"]
    rows = read_table(spark, existing(paths, "sessions.db", "sessions/sessions.db", "data/sessions/sessions.db"), "sessions", columns, "model_config_json IS NOT NULL AND TRIM(model_config_json) != ''")
    n = lambda c: counter(F.coalesce(F.col(c), F.lit("")))
    day = F.trim("created_at")
    loose = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$"), F.concat(F.substring(day, 1, 10), F.lit("T"), F.substring(day, 12, 8), F.lit("Z"))).when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(day, F.lit("T00:00:00Z"))).otherwise(day)
    rows = rows.withColumns({"i": first_positive(n("accumulated_input_tokens"), n("input_tokens")), "o": first_positive(n("accumulated_output_tokens"), n("output_tokens"))})
    rows = rows.withColumn("t", first_positive(n("accumulated_total_tokens"), n("total_tokens"), F.col("i") + F.col("o")))
    tokens = usage(F.col("i"), F.col("o"), 0, 0, 0, F.greatest(F.col("t") - F.col("i") - F.col("o"), F.lit(0)))
    rows = rows.withColumns({"source_file": F.col("path"), "timestamp": parse_timestamp(loose), "usage": apply_total(tokens, bucket_sum(tokens)), **identity("goose", "goose", "Goose", F.trim("id"), v.text(F.try_parse_json("model_config_json"), "$.model_name"), "Goose")})
    rows = finished(rows.where("timestamp is not null and session_id <> '' and model <> ''"), F.concat(F.lit("goose:"), F.col("session_id"), F.lit(":"), F.coalesce(F.trim("provider_name"), F.lit(""))))
    return first_wins(rows, ["source_file", "session_id"], ["timestamp", "id"])


register_provider(Provider("goose", load_goose))


# codebuff
def codebuff_usage(j: Column, at: str) -> Column:
    """struct(model, usage) of a usage object under several names; a total beyond the buckets is reasoning."""
    n = lambda *names: v.count(j, *[f"{at}.{x}" for x in names])
    read = F.greatest(n("cacheReadInputTokens", "cache_read_input_tokens"), v.count(j, f"{at}.promptTokensDetails.cachedTokens"), v.count(j, f"{at}.prompt_tokens_details.cached_tokens"))
    tokens = usage(n("inputTokens", "input_tokens", "promptTokens", "prompt_tokens"), n("outputTokens", "output_tokens", "completionTokens", "completion_tokens"), n("cacheCreationInputTokens", "cache_creation_input_tokens", "cacheCreationTokens", "cache_creation_tokens"), read)
    return F.struct(v.text(j, f"{at}.model").alias("model"), apply_total(tokens, n("totalTokens", "total_tokens", "total")).alias("u"))


def load_codebuff(spark: SparkSession, paths: list[str]) -> DataFrame:
    docs = read_documents(spark, paths, r"/chat-messages\.json$").withColumn("v", F.try_parse_json("value"))
    rows = docs.select("path", "mtime", F.posexplode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array().cast("array<variant>"))).alias("at", "v"))
    j = F.col("v")
    rows = rows.where(v.text(j, "$.variant", "$.role").isin("ai", "agent", "assistant"))
    history = F.reverse(v.array(j, "$.metadata.runState.sessionState.mainAgentState.messageHistory"))
    turns = F.filter(history, lambda h: (v.text(h, "$.role") == "assistant") & v.kind(h, "$.providerOptions").startswith("OBJECT"))
    told = F.flatten(F.transform(turns, lambda h: F.array(codebuff_usage(h, "$.providerOptions.usage"), codebuff_usage(h, "$.providerOptions.codebuff.usage"), F.struct(v.text(h, "$.providerOptions.codebuff.model").alias("model"), usage().alias("u")))))
    levels = F.concat(F.array(F.struct(v.text(j, "$.metadata.model").alias("model"), usage().alias("u")), codebuff_usage(j, "$.metadata.usage"), codebuff_usage(j, "$.metadata.codebuff.usage")), told)
    rows = rows.withColumn("levels", levels)
    first = lambda c: F.coalesce(F.try_element_at(F.filter(F.transform("levels", lambda x: x[f"u"][c]), lambda n: n > 0), F.lit(1)), F.lit(0))
    tokens = usage(first("input_tokens"), first("output_tokens"), first("cache_creation_input_tokens"), first("cache_read_input_tokens"), 0, first("reasoning_output_tokens"))
    model = F.coalesce(F.try_element_at(F.filter(F.transform("levels", lambda x: x["model"]), lambda m: m != ""), F.lit(1)), F.lit("codebuff-unknown"))
    up = lambda n: base(F.regexp_replace(F.col("path"), r"(/[^/]*){%d}$" % n, ""))
    chat = up(1)
    session = F.concat(up(5), F.lit("/"), up(3), F.lit("/"), chat)
    clock = F.regexp_replace(chat, r"^([^T]*)T([^-]*)-([^-]*)-", "$1T$2:$3:")
    rows = rows.withColumns({"tokens": tokens, "source_file": F.col("path"), "source_line": (F.col("at") + 1).cast("int"), "timestamp": F.coalesce(v.time(j, "$.timestamp", "$.createdAt", "$.metadata.timestamp"), parse_timestamp(clock), F.col("mtime")), "own_id": v.text(j, "$.id"), **identity("codebuff", "codebuff", "Codebuff", session, model, "Codebuff")})
    rows = rows.withColumn("usage", apply_total(F.col("tokens"), bucket_sum(F.col("tokens"))))
    key = F.when(F.col("own_id") != "", F.concat(F.lit("codebuff:"), F.col("session_id"), F.lit(":"), F.col("own_id"))).otherwise(F.concat_ws(":", F.col("session_id"), F.col("source_line").cast("string")))
    return last_wins(finished(rows, key), ["id"], ["source_file", "source_line"]).drop("position")


register_provider(Provider("codebuff", load_codebuff))
