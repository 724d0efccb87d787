"""Providers whose rows depend on the rows around them, as windows over each source file or session."""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelake.functions import variants as v
from usagelake.functions.binding import let, settled
from usagelake.functions.evidence import CHANGED, READ, WEIGHED, language_udf, of_arguments, of_claude, of_payload, told, weighed
from usagelake.functions.ids import COUNTERS, stable_id
from usagelake.functions.language import language_of
from usagelake.functions.patches import diff_counts, envelope_changes, hunk_counts
from usagelake.functions.paths import base, clean, join, is_absolute, project_from_cwd, resolve_path
from usagelake.functions.text import count_lines, first_non_empty, is_semver_prefix, normalize_client, normalize_language
from usagelake.functions.times import LIMIT_REACHED, limit_reset, rfc3339_nano
from usagelake.functions.tokens import apply_total, bucket_sum, non_zero, usage
from usagelake.operators.dedupe import first_wins, keep_best, last_wins
from usagelake.operators.files import file_rollup, with_language
from usagelake.operators.precedence import preferred_union
from usagelake.operators.sequence import attributed_to, carried, counter_deltas, final_value, growth, up_to_here
from usagelake.providers.base import Provider, existing, finished, line_source, register_provider
from usagelake.providers.simple import has, identity, stem
from usagelake.sources.lines import read_documents, read_lines
from usagelake.sources.sqlite import read_table

CHANGE = "array<struct<path:string,lines_added:bigint,lines_removed:bigint>>"


def with_changes(rows: DataFrame, changes: DataFrame, keys: list[str], order: list[str], tie: str) -> DataFrame:
    """rows with the roll-up of their file changes: line counts, files, entity and is_write."""
    rolled = file_rollup(changes, keys, order, tie)
    rows = rows.drop("lines_added", "lines_removed", "files", "entity", "is_write", "entity_type").join(rolled, keys, "left")
    return rows.withColumn("entity_type", F.when(F.coalesce("entity", F.lit("")) != "", "file").otherwise(""))


# claude
# Fields that no line may hold as null.
NOT_NULL = r'"(id|cwd|model|speed|costUSD|version|sessionId|requestId|isApiErrorMessage|cache_read_input_tokens|cache_creation_input_tokens)":null'


def claude_kinds(lines: DataFrame) -> DataFrame:
    """Usage rows (is_usage) and rows with a patch, with their record (v)."""
    j = F.col("v")
    rows = v.records(lines)
    use = F.col("value").contains('"usage":{') & ~F.col("value").rlike(NOT_NULL) & has("$.message.usage")
    absent = lambda p: F.try_variant_get(j, p, "variant").isNull()
    for p in ("$.sessionId", "$.requestId", "$.message.model"):
        use = use & (absent(p) | (v.text(j, p) != ""))
    version, speed = v.text(j, "$.version"), v.text(j, "$.message.usage.speed")
    use = use & (v.text(j, "$.message.id") != "") & (absent("$.version") | is_semver_prefix(version)) & speed.isin("", "standard", "fast") & v.time(j, "$.timestamp").isNotNull()
    hunks = F.flatten(F.transform(v.array(j, "$.toolUseResult.structuredPatch"), lambda h: F.coalesce(F.try_variant_get(h, "$.lines", "array<string>"), F.array().cast("array<string>"))))
    counts, n_hunks = hunk_counts(hunks), F.size(v.array(j, "$.toolUseResult.structuredPatch"))
    file = F.coalesce(F.try_variant_get(j, "$.toolUseResult.filePath", "string"), F.lit(""))
    made = (n_hunks == 0) & (F.try_variant_get(j, "$.toolUseResult.type", "string") == "create") & (file != "")
    content = F.coalesce(F.try_variant_get(j, "$.toolUseResult.content", "string"), F.lit(""))
    patch = F.when(made, F.struct(file.alias("path"), count_lines(content).alias("lines_added"), F.lit(0).cast("long").alias("lines_removed"))).when(n_hunks > 0, F.struct(file.alias("path"), counts["lines_added"].alias("lines_added"), counts["lines_removed"].alias("lines_removed")))
    rows = settled(rows, "is_usage", F.coalesce(use, F.lit(False)))
    rows = settled(rows, "patch", F.when(F.col("value").contains('"structuredPatch"'), patch))
    return rows.where("is_usage or patch is not null")


def claude_limits(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Usage rows that tell of a reached limit: source_file, source_start, timestamp, resets_at."""
    j = F.col("v")
    rows = claude_kinds(line_source(read_lines(spark, paths, r"/projects/.*\.[jJ][sS][oO][nN][lL]$", LIMIT_REACHED))).where("is_usage")
    rows = rows.select("source_file", "source_start", v.time(j, "$.timestamp").alias("timestamp"), limit_reset(F.col("value"), F.try_variant_get(j, "$.isApiErrorMessage", "boolean")).alias("resets_at"))
    return rows.where("resets_at is not null")


def claude_marked(lines: DataFrame) -> DataFrame:
    return claude_kinds(lines).select(*lines.columns, F.lit(True).alias("needed"), F.col("is_usage").alias("opens"))


def claude_rows(lines: DataFrame) -> DataFrame:
    """Usage rows with their patches; patches go to the usage row before them in the file, else to the first after."""
    j = F.col("v")
    absent = lambda p: F.try_variant_get(j, p, "variant").isNull()
    rows = claude_kinds(line_source(lines)).withColumn("target", attributed_to(F.col("is_usage"), F.col("source_start"), ["source_file"], ["source_start"]))
    model, speed = v.text(j, "$.message.model"), v.text(j, "$.message.usage.speed")
    tokens = usage(*[v.count(j, f"$.message.usage.{c}") for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")])
    project = project_from_cwd(v.text(j, "$.cwd"))
    session = F.coalesce(F.nullif(F.regexp_extract("source_file", r"/projects/[^/]+/([^/]+)/[^/]+\.jsonl$", 1), F.lit("")), stem(F.col("source_file")))
    found = rows.where("is_usage").withColumns({
        "timestamp": v.time(j, "$.timestamp"),
        "usage": apply_total(tokens, bucket_sum(tokens)),
        "speed": speed,
        "message_id": v.text(j, "$.message.id"),
        "request_id": F.when(~absent("$.requestId"), v.text(j, "$.requestId")),
        "branch": v.text(j, "$.gitBranch"),
        "language": language_udf(of_claude)(F.to_json(F.try_variant_get(j, "$.message.content", "variant"))),
        **identity("claude", first_non_empty(project["project"], F.lit("Unknown")), project["project_path"], session, F.when(model == "<synthetic>", "").when(speed == "fast", F.concat(model, F.lit("-fast"))).otherwise(model), ""),
        "client": normalize_client(F.lit("claude"), v.text(j, "$.entrypoint")),
    })
    changes = rows.where("patch is not null and target is not null").select("source_file", F.col("target").alias("source_start"), F.col("source_start").alias("at"), "patch.*")
    return with_changes(found, changes, ["source_file", "source_start"], ["at"], "touched")


def claude_id() -> Column:
    return stable_id(F.lit("claude"), F.col("message_id"), F.col("request_id"))


def claude_lines(lines: DataFrame) -> DataFrame:
    return finished(claude_rows(lines), keep_zero=True, id_column=claude_id())


def load_claude(spark: SparkSession, paths: list[str], dedupe: str = "best") -> DataFrame:
    """dedupe: "best" keeps of rows of one message and request the one with most tokens, "first" the first."""
    rows = claude_rows(read_lines(spark, paths, r"/projects/.*\.[jJ][sS][oO][nN][lL]$"))
    order = ["source_file", "source_start"]
    rows = keep_best(rows, ["message_id", "request_id"], bucket_sum(F.col("usage")), F.col("speed") != "", order) if dedupe == "best" else first_wins(rows, ["message_id", "request_id"], order)
    return finished(rows, keep_zero=True, id_column=claude_id())


register_provider(Provider("claude", load_claude, (), claude_lines, lambda project: lambda path: path.contains(f"/projects/{project}/"), claude_marked))


# codex
CODEX_FIELDS = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]


def codex_account(t: Column) -> Column:
    plain = F.when(t["cached_input_tokens"] <= t["input_tokens"], t["input_tokens"] - t["cached_input_tokens"]).otherwise(0)
    return usage(plain, t["output_tokens"], 0, t["cached_input_tokens"], 0, t["reasoning_output_tokens"], t["total_tokens"])


def load_codex(spark: SparkSession, paths: list[str]) -> DataFrame:
    j, keys, order = F.col("v"), ["source_file"], ["source_start"]
    rows = v.records(line_source(read_lines(spark, paths, r"/(sessions|archived_sessions)/.*\.[jJ][sS][oO][nN][lL]$", '"type"')))
    kind, inner = v.text(j, "$.type"), v.text(j, "$.payload.type")
    meta, turn = kind == "session_meta", kind == "turn_context"
    only = lambda condition, c: F.when(condition, c).otherwise("")
    rows = rows.withColumns({"kind": kind, "inner": inner, "lang": F.regexp_replace(language_udf(of_payload)(F.to_json(F.try_variant_get(j, "$.payload", "variant"))), "^Unknown$", "")})
    state = {"session": only(meta, v.text(j, "$.payload.id")), "cwd": only(meta | turn, v.text(j, "$.payload.cwd")), "client": only(meta, normalize_client(F.lit("codex"), v.text(j, "$.payload.originator"))), "model": only(turn, v.text(j, "$.payload.model")), "lang": F.col("lang")}
    rows = rows.withColumns(state).withColumns({c: carried(F.col(c), keys, order) for c in state})
    counts = lambda at: F.when(has(at), F.struct(*[v.count(j, f"{at}.{c}").alias(c) for c in CODEX_FIELDS]))
    rows = rows.withColumns({"last": counts("$.payload.info.last_token_usage"), "total": counts("$.payload.info.total_token_usage"), "timestamp": v.time(j, "$.timestamp")})
    counted = rows.where("kind = 'event_msg' and inner = 'token_count' and last is not null and timestamp is not null")
    emitted = counter_deltas(counted, keys, order, "total", "last", CODEX_FIELDS)
    # Patch calls wait for the first confirmation of their call id after them; a repeated call replaces the one before.
    calls = (F.col("kind") == "response_item") & F.col("inner").isin("custom_tool_call", "function_call")
    replies = ((F.col("kind") == "response_item") & F.col("inner").isin("custom_tool_call_output", "function_call_output")) | ((F.col("kind") == "event_msg") & (F.col("inner") == "patch_apply_end"))
    body = F.concat_ws("\n", v.text(j, "$.payload.input"), *[v.text(F.try_parse_json(v.text(j, "$.payload.arguments")), p) for p in ("$.input", "$.patch")], F.array_join(F.coalesce(F.try_variant_get(F.try_parse_json(v.text(j, "$.payload.arguments")), "$.command", "array<string>"), F.array().cast("array<string>")), "\n"))
    patch = F.when(calls, envelope_changes(body))
    output = F.coalesce(F.try_variant_get(j, "$.payload.output", "string"), F.lit(""))
    coded = F.try_variant_get(F.try_parse_json(output), "$.metadata.exit_code", "int")
    done = F.when(F.col("inner") == "patch_apply_end", F.coalesce(F.try_variant_get(j, "$.payload.success", "boolean"), F.lit(False))).otherwise(F.coalesce(coded == 0, ~F.lower(output).rlike(r"(^|\W)(error|failed|failure)(\W|$)|exit code: [1-9]")))
    steps = rows.withColumns({"call_id": v.text(j, "$.payload.call_id"), "patch": patch, "ok": done, "reply": replies}).where("call_id <> '' and (reply or size(patch) > 0)")
    by_call = Window.partitionBy("source_file", "call_id").orderBy("source_start")
    steps = steps.withColumn("waiting", F.when(F.col("reply") & ~F.coalesce(F.lag("reply").over(by_call), F.lit(True)) & F.col("ok"), F.lag(F.struct("patch", "cwd")).over(by_call)))
    steps = steps.where("waiting is not null").select("source_file", "source_start", F.col("waiting.cwd").alias("at_cwd"), F.posexplode("waiting.patch").alias("n", "c"))
    steps = steps.select("source_file", "source_start", "n", F.when(is_absolute(F.col("c.path")) | (F.col("at_cwd") == ""), F.col("c.path")).otherwise(join(F.col("at_cwd"), F.col("c.path"))).alias("path"), "c.lines_added", "c.lines_removed")
    marks = emitted.select("source_file", "source_start", F.lit(True).alias("entry"))
    both = steps.withColumn("entry", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    placed = both.withColumn("target", attributed_to(F.col("entry"), F.col("source_start"), keys, ["source_start"], following_only=True)).where("not entry and target is not null")
    changes = placed.select("source_file", F.col("target").alias("own_start"), F.col("source_start").alias("at"), "n", "path", "lines_added", "lines_removed").withColumnRenamed("own_start", "source_start")
    name = base(clean(F.trim("cwd")))
    session = first_non_empty(F.col("session"), F.coalesce(F.nullif(F.regexp_extract(stem(F.col("source_file")), r"^rollout-(?:\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}-)?(.+)$", 1), F.lit("")), stem(F.col("source_file"))))
    emitted = emitted.withColumns({"usage": codex_account(F.col("delta")), "reported": codex_account(F.col("last")), "language": normalize_language(F.col("lang")), "own_client": F.col("client"), **identity("codex", F.when((F.trim("cwd") == "") | name.isin(".", "/"), "Unknown").otherwise(name), F.col("cwd"), session, F.col("model"), "")}).withColumn("client", F.col("own_client"))
    r = F.col("reported")
    own_id = stable_id(F.lit("codex"), F.col("session_id"), rfc3339_nano(F.col("timestamp")), F.col("model"), *[r[c] for c in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")])
    return finished(with_changes(emitted, changes, ["source_file", "source_start"], ["at", "n"], "first"), keep_zero=True, id_column=own_id)


register_provider(Provider("codex", load_codex))


# opencode and kilo
def tool_parts(parts: DataFrame, writers: tuple[str, ...], patchers: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """File changes, and paths as evidence of a language, of the completed tool calls among parts (source_file, message, t, id, v)."""
    j = F.col("v")
    parts = parts.where((v.text(j, "$.type") == "tool") & (v.text(j, "$.state.status") == "completed"))
    tool, at = v.text(j, "$.tool"), "$.state.input."
    file = v.text(j, at + "filePath", at + "path")
    diff = F.coalesce(F.try_variant_get(j, "$.state.metadata.diff", "string"), F.lit(""))
    stat = lambda c: F.try_variant_get(j, f"$.state.metadata.filediff.{c}", "long")
    write = F.coalesce(F.try_variant_get(j, at + "content", "string"), F.lit(""))
    one = F.struct(file.alias("path"), F.coalesce(stat("additions"), F.when(diff != "", diff_counts(diff)["lines_added"]), F.when(tool == "write", count_lines(write)), F.lit(0)).cast("long").alias("lines_added"), F.coalesce(stat("deletions"), F.when(diff != "", diff_counts(diff)["lines_removed"]), F.lit(0)).cast("long").alias("lines_removed"))
    patched = envelope_changes(F.coalesce(F.try_variant_get(j, at + "patchText", "string"), F.lit("")), needs_begin=False)
    changed = F.when(tool.isin(*patchers), patched).when(tool.isin(*writers) & (file != ""), F.array(one)).otherwise(F.array().cast(CHANGE))
    parts = parts.withColumn("changed", changed)
    changes = parts.select("source_file", "message", "t", "id", F.posexplode("changed").alias("n", "c")).select("source_file", "message", "t", "id", "n", "c.*")
    read = v.text(j, at + "filePath")
    seen = F.when(F.size("changed") > 0, weighed(F.transform("changed", lambda c: c["path"]), CHANGED)).when((tool == "read") & (read != ""), weighed(F.array(read), READ)).when(tool == "bash", told(v.text(j, at + "command"))).when(tool.isin("glob", "grep"), told(v.text(j, at + "pattern"))).otherwise(F.array().cast(WEIGHED))
    return changes, parts.select("source_file", "message", F.explode(seen).alias("e")).select("source_file", "message", "e.*")


#: Tools that change files, and tools that take patches, of the two programs.
OPENCODE_TOOLS = (("edit", "write", "multiedit"), ("patch", "apply_patch"))
KILO_TOOLS = (("edit", "write"), ())


def session_rows(spark: SparkSession, dbs: list[str], tools: tuple[tuple[str, ...], tuple[str, ...]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages of databases with their session, and file changes and language evidence of the messages' parts."""
    sessions = read_table(spark, dbs, "session", ["id", "directory", "version", "model"])
    m = F.try_parse_json("model")
    sessions = sessions.select("path", F.col("id").alias("session_id"), F.coalesce("directory", F.lit("")).alias("directory"), first_non_empty(v.text(m, "$.id", "$.modelID")).alias("session_model"))
    j = F.col("v")
    messages = v.records(read_table(spark, dbs, "message", ["id", "session_id", "time_created", "data"]), "data")
    messages = messages.select("path", "row", first_non_empty(v.text(j, "$.id"), F.col("id")).alias("message"), first_non_empty(v.text(j, "$.sessionID"), F.col("session_id")).alias("session_id"), F.col("time_created").try_cast("long").alias("created"), "v")
    messages = messages.join(sessions, ["path", "session_id"], "left")
    parts = v.records(read_table(spark, dbs, "part", ["id", "message_id", "time_created", "data"]), "data")
    parts = parts.select(F.col("path").alias("source_file"), F.col("message_id").alias("message"), F.col("time_created").try_cast("long").alias("t"), "id", "v")
    return messages, *tool_parts(parts, *tools)


def message_events(messages: DataFrame, changes: DataFrame, evidence: DataFrame, name: str, title: str, running: bool) -> DataFrame:
    j = F.col("v")
    reported = usage(v.count(j, "$.tokens.input"), v.count(j, "$.tokens.output"), v.count(j, "$.tokens.cache.write"), v.count(j, "$.tokens.cache.read"), 0, v.count(j, "$.tokens.reasoning"))
    rows = settled(messages, "reported", reported).where(non_zero(F.col("reported")))
    keys, order = ["path", "session_id"], ["created", "message"]
    r = F.col("reported")
    if running:
        grown = {c: growth(r[c], keys, order) for c in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")}
        rows = rows.withColumn("billed", usage(grown["input_tokens"], r["output_tokens"], grown["cache_creation_input_tokens"], grown["cache_read_input_tokens"], 0, r["reasoning_output_tokens"]))
    else:
        rows = rows.withColumn("billed", r)
    project = project_from_cwd(first_non_empty(v.text(j, "$.path.cwd"), F.coalesce("directory", F.lit(""))))
    when = F.coalesce(v.time(j, "$.time.created"), v.time(F.try_parse_json(F.col("created").cast("string")), "$"), F.timestamp_millis(F.coalesce("created", F.lit(0))))
    rows = rows.withColumns({"source_file": F.col("path"), "timestamp": when, "usage": apply_total(F.col("billed"), F.lit(0)), **identity(name, first_non_empty(project["project"], F.lit("Unknown")), project["project_path"], F.col("session_id"), first_non_empty(v.text(j, "$.modelID", "$.model.modelID", "$.model"), F.coalesce("session_model", F.lit(""))), title)})
    keyed = changes.join(rows.select("source_file", "message", "project_path"), ["source_file", "message"])
    keyed = keyed.withColumn("path", resolve_path(F.col("project_path"), F.col("path")))
    rows = with_changes(rows.drop("path"), keyed, ["source_file", "message"], ["t", "id", "n"], "last")
    rows = with_language(rows, evidence, ["source_file", "message"])
    return finished(rows, id_column=stable_id(F.lit(name), F.col("message")))


def load_opencode(spark: SparkSession, paths: list[str]) -> DataFrame:
    dbs = sorted({p for root in paths for p in ([root] if os.path.isfile(root) else glob.glob(os.path.join(root, "opencode*.db"))) if os.path.isfile(p)})
    stored = message_events(*session_rows(spark, dbs, OPENCODE_TOOLS), "opencode", "OpenCode", running=True)
    j = F.col("v")
    legacy = v.records(read_documents(spark, paths, r"/storage/message/.*\.json$"))
    legacy = legacy.select("path", F.lit(0).cast("long").alias("row"), first_non_empty(v.text(j, "$.id"), stem(F.col("path"))).alias("message"), first_non_empty(v.text(j, "$.sessionID"), F.lit("unknown")).alias("session_id"), F.unix_millis("mtime").alias("created"), "v", F.lit("").alias("directory"), F.lit("").alias("session_model"))
    # Parts of a message lie beside it, a file each: storage/part/<message>/<part>.json.
    parts = v.records(read_documents(spark, paths, r"/storage/part/.*\.json$"))
    owner = first_non_empty(v.text(j, "$.messageID"), F.regexp_extract("path", r"/storage/part/([^/]+)/[^/]+$", 1))
    parts = parts.select(F.regexp_extract("path", "^(.*)/storage/part/", 1).alias("root"), owner.alias("message"), F.unix_millis("mtime").alias("t"), first_non_empty(v.text(j, "$.id"), stem(F.col("path"))).alias("id"), "v")
    homes = legacy.select(F.regexp_extract("path", "^(.*)/storage/message/", 1).alias("root"), F.col("path").alias("source_file"), "message")
    old = message_events(legacy, *tool_parts(parts.join(homes, ["root", "message"]), *OPENCODE_TOOLS), "opencode", "OpenCode", running=False)
    return preferred_union(stored, old, ["id"], ["source_file"])


def load_kilo(spark: SparkSession, paths: list[str]) -> DataFrame:
    return first_wins(message_events(*session_rows(spark, existing(paths, "kilo.db"), KILO_TOOLS), "kilo", "Kilo Code", running=False), ["id"], ["source_file", "timestamp"])


register_provider(Provider("opencode", load_opencode))
register_provider(Provider("kilo", load_kilo))


# gemini
def gemini_usage(j: Column, at: str, reasoning: str = "thoughts") -> Column:
    """Tokens whose input may or may not contain what was cached: the total tells which."""
    n = lambda *names: v.count(j, *[f"{at}.{x}" for x in names])
    read = {"raw": n("input", "prompt"), "cached": n("cached"), "out": n("output", "candidates"), "thought": n(reasoning), "tool": n("tool"), "total": n("total")}
    return let(F.struct(*[c.alias(k) for k, c in read.items()]), lambda s: _gemini_buckets(*[s[k] for k in read]))


def _gemini_buckets(raw: Column, cached: Column, out: Column, thought: Column, tool: Column, total: Column) -> Column:
    apart = raw + cached + out + thought + tool
    inside = raw + out + thought + tool
    input_ = F.when((total > 0) & (total == apart) & (total != inside), raw).otherwise(F.greatest(raw - cached, F.lit(0)))
    return apply_total(usage(input_ + tool, out, 0, cached, 0, thought), total)


def project_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """folder, root: what the .project_root files in the folders of tmp say. Spark's readers pass over names that begin with a
    dot, so these files of one line each are opened here."""
    Path, rows = spark._jvm.org.apache.hadoop.fs.Path, {}
    for path in sorted(set(filter(None, paths))):
        fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for pattern in ("*/.project_root", "tmp/*/.project_root"):
            for found in fs.globStatus(Path(path.rstrip("/") + "/" + pattern)) or []:
                stream = fs.open(found.getPath())
                said = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
                stream.close()
                rows[re.sub("^[a-z]*:/+", "/", found.getPath().getParent().toString())] = said
    return spark.createDataFrame(sorted(rows.items()), "folder string, root string")


def load_gemini(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Message logs: checkpoints repeat messages by id, of which the last content counts at the first place."""
    j, keys = F.col("v"), ["source_file"]
    chats = r"/chats/.*\.[jJ][sS][oO][nN][lL]?$"
    lines = v.records(line_source(read_lines(spark, paths, F.col("path").rlike(r"/chats/.*\.[jJ][sS][oO][nN][lL]$"))))
    docs = v.records(read_documents(spark, paths, F.col("path").rlike(r"\.[jJ][sS][oO][nN]$") & F.col("path").contains("/tmp/"))).select(F.col("path").alias("source_file"), "mtime", F.lit(1).alias("source_line"), F.lit(0).cast("long").alias("source_start"), F.lit(0).cast("long").alias("source_end"), "value", "v")
    rows = lines.select(*docs.columns).unionByName(docs)
    rows = rows.withColumns({"said_model": v.text(j, "$.model"), "said_session": v.text(j, "$.sessionId")})
    rows = rows.withColumns({"final_model": final_value(F.col("said_model"), keys, ["source_start"]), "session": first_non_empty(final_value(F.col("said_session"), keys, ["source_start"]), stem(F.col("source_file"))), "run_model": carried(F.col("said_model"), keys, ["source_start"])})
    listed = F.concat(v.array(j, "$['$set'].messages"), v.array(j, "$.messages"))
    messages = rows.where(v.text(j, "$.type") == "gemini").withColumn("n", F.lit(0)).unionByName(rows.select(*[c for c in rows.columns if c != "v"], F.posexplode(listed).alias("n", "v")).where(v.text(F.col("v"), "$.type") == "gemini"), allowMissingColumns=True)
    messages = messages.withColumn("own_id", v.text(j, "$.id")).withColumn("key", F.when(F.col("own_id") != "", F.col("own_id")).otherwise(F.concat_ws(":", F.col("source_start"), F.col("n"))))
    messages = last_wins(messages, ["source_file", "key"], ["source_start", "n"]).drop("position")
    messages = messages.withColumns({"timestamp": F.coalesce(v.time(j, "$.timestamp"), F.col("mtime")), "usage": gemini_usage(j, "$.tokens"), "m": first_non_empty(v.text(j, "$.model"), F.col("final_model"), F.lit("unknown"))})
    models = rows.select(*[c for c in rows.columns if c != "v"], F.explode(F.coalesce(F.try_variant_get(j, "$.stats.models", "map<string,variant>"), F.create_map().cast("map<string,variant>"))).alias("m", "v"))
    models = models.withColumns({"timestamp": F.col("mtime"), "usage": gemini_usage(j, "$.tokens"), "key": F.col("m"), "own_id": F.col("m"), "n": F.lit(0)})
    both = messages.unionByName(models, allowMissingColumns=True)
    folder = first_non_empty(F.regexp_extract("source_file", r"^(.*/[^/]+)/chats/", 1), F.regexp_extract("source_file", r"^(.*/tmp/[^/]+)/", 1))
    both = both.withColumn("folder", folder).withColumns({"slug": F.regexp_extract("folder", "([^/]*)$", 1), "home": F.regexp_replace("folder", "/[^/]+/[^/]+$", "")})
    # A folder names its project in a file of its own, else the registry beside the folders does: project path to slug, or to the path's hash.
    roots = project_files(spark, paths)
    listed = read_documents(spark, paths, r"/projects\.json$").select(F.regexp_replace("path", "/projects\\.json$", "").alias("home"), F.explode(F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$.projects", "map<string,string>"), F.create_map().cast("map<string,string>"))).alias("cwd", "name")).where("cwd <> '' and trim(name) <> ''")
    registry = listed.select("home", "cwd", F.explode(F.array(F.trim("name"), F.sha2("cwd", 256))).alias("slug")).groupBy("home", "slug").agg(F.min("cwd").alias("registered"))
    both = both.join(roots, "folder", "left").join(registry, ["home", "slug"], "left").withColumn("root", first_non_empty(F.col("root"), F.col("registered")))
    project = project_from_cwd(F.coalesce("root", F.lit("")))
    hashed = F.col("slug").rlike("^[0-9a-f]{32,}$")
    both = both.withColumns(identity("gemini", first_non_empty(project["project"], F.when(hashed | (F.col("slug") == ""), "Unknown").otherwise(F.col("slug"))), project["project_path"], F.col("session"), F.col("m"), "Gemini CLI"))
    calls = messages.select("source_file", "key", F.posexplode(v.array(j, "$.toolCalls")).alias("at", "v")).where(v.text(j, "$.status").isin("", "success"))
    stat = lambda c: v.count(j, f"$.resultDisplay.diffStat.{c}")
    lines = lambda c: count_lines(F.coalesce(F.try_variant_get(j, f"$.args.{c}", "string"), F.lit("")))
    file = v.text(j, "$.resultDisplay.filePath", "$.resultDisplay.fileName", "$.args.file_path", "$.args.filePath", "$.args.absolute_path")
    name = F.lower(v.text(j, "$.name"))
    written, edited = name.isin("write_file", "writefile"), name.isin("replace", "edit")
    changed = lambda c, text: F.when(has("$.resultDisplay.diffStat"), stat(c)).otherwise(lines(text))
    changes = calls.where((file != "") & (written | edited))
    changes = changes.select("source_file", "key", "at", file.alias("path"), F.when(written, lines("content")).otherwise(changed("model_added_lines", "new_string")).alias("lines_added"), F.when(written, 0).otherwise(changed("model_removed_lines", "old_string")).cast("long").alias("lines_removed"))
    paths_of = both.select("source_file", "key", "project_path").distinct()
    changes = changes.join(paths_of, ["source_file", "key"]).withColumn("path", resolve_path(F.col("project_path"), F.col("path")))
    both = with_changes(both, changes, ["source_file", "key"], ["at"], "last")
    told_of = calls.select("source_file", "key", F.explode(of_arguments(F.try_variant_get(j, "$.args", "variant"), either=False)).alias("e")).select("source_file", "key", "e.*")
    both = with_language(both, told_of, ["source_file", "key"])
    return first_wins(finished(both, F.col("own_id")), ["id"], ["source_file", "source_start"])


register_provider(Provider("gemini", load_gemini))


# workbuddy
def load_workbuddy(spark: SparkSession, paths: list[str]) -> DataFrame:
    j, keys, order = F.col("v"), ["source_file"], ["source_start"]
    rows = v.records(line_source(read_lines(spark, paths, r"/projects/.*\.[jJ][sS][oO][nN][lL]$")))
    at = "$.providerData.rawUsage."
    n = lambda *names: [v.count(j, at + x) for x in names]
    prompt, out = F.greatest(*n("prompt_tokens", "input_tokens")), F.greatest(*n("completion_tokens", "output_tokens"))
    cached = F.greatest(*n("prompt_tokens_details.cached_tokens", "prompt_cache_hit_tokens", "cache_read_input_tokens"))
    thought = F.least(F.greatest(*n("completion_tokens_details.reasoning_tokens", "reasoning_tokens")), out)
    tokens = usage(F.greatest(prompt - cached, F.lit(0)), out - thought, 0, cached, 0, thought)
    rows = rows.withColumns({"message": v.text(j, "$.providerData.messageId"), "usage": apply_total(tokens, v.count(j, at + "total_tokens")), "timestamp": F.coalesce(v.time(j, "$.timestamp"), F.col("mtime"))})
    rows = settled(rows, "entry", has("$.providerData.rawUsage") & non_zero(F.col("usage")))
    project = project_from_cwd(v.text(j, "$.cwd"))
    lead = lambda c: first_non_empty(final_value(c, keys, order))
    rows = rows.withColumns({"said": v.text(j, "$.cwd")}).withColumn("cwd", F.coalesce(F.nullif(F.col("said"), F.lit("")), F.first(F.nullif(F.col("said"), F.lit("")), ignorenulls=True).over(Window.partitionBy(*keys))))
    project = project_from_cwd(F.coalesce("cwd", F.lit("")))
    session = first_non_empty(v.text(j, "$.sessionId"), stem(F.col("source_file")))
    found = rows.where("entry").withColumns(identity("workbuddy", first_non_empty(project["project"], F.lit("Unknown")), project["project_path"], session, first_non_empty(v.text(j, "$.providerData.model", "$.providerData.requestModelId"), F.lit("unknown")), "WorkBuddy"))
    # Records of tool calls belong to the first entry of their message, else to the nearest entry before them.
    firsts = found.groupBy("source_file", "message").agg(F.min("source_start").alias("own")).where("message <> ''")
    nearest = attributed_to(F.col("entry"), F.col("source_start"), keys, order)
    routed = rows.withColumn("nearest", nearest).join(firsts, ["source_file", "message"], "left").withColumn("target", F.coalesce("own", "nearest")).where("target is not null").withColumns({"kind": v.text(j, "$.type"), "name": v.text(j, "$.name"), "args": F.try_parse_json(F.try_variant_get(j, "$.arguments", "string"))})
    arg = F.col("args")
    lines = lambda c: count_lines(F.coalesce(F.try_variant_get(arg, f"$.{c}", "string"), F.lit("")))
    calls = routed.where("kind = 'function_call' and args is not null")
    changes = calls.where(F.col("name").isin("Write", "Edit") & (v.text(arg, "$.file_path") != ""))
    wrote = F.col("name") == "Write"
    changes = changes.select("source_file", F.col("target").alias("source_start"), F.col("source_line").alias("at"), resolve_path(F.col("said"), v.text(arg, "$.file_path")).alias("path"), F.when(wrote, lines("content")).otherwise(lines("new_string")).alias("lines_added"), F.when(wrote, 0).otherwise(lines("old_string")).cast("long").alias("lines_removed"))
    found = with_changes(found, changes, ["source_file", "source_start"], ["at"], "last")
    spoken = F.concat(F.transform(v.array(j, "$.content"), lambda b: v.text(b, "$.text")), F.array(v.text(j, "$.content")))
    seen = F.when(F.col("kind") == "function_call", of_arguments(arg, either=True)).when(F.col("kind") == "message", F.flatten(F.transform(spoken, told))).otherwise(F.array().cast(WEIGHED))
    told_of = routed.select("source_file", F.col("target").alias("source_start"), F.explode(seen).alias("e")).select("source_file", "source_start", "e.*")
    found = with_language(found, told_of, ["source_file", "source_start"])
    key = [F.col("message"), *[F.col(f"usage.{c}") for c in COUNTERS]]
    return first_wins(finished(found, id_column=stable_id(F.lit("workbuddy"), F.col("session_id"), *key)), ["id"], ["timestamp", "source_file", "source_start"])


register_provider(Provider("workbuddy", load_workbuddy))
