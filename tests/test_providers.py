"""One small source for each provider, and what becomes of it."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from usagelake.api import load_usage
from usagelake.functions.ids import COUNTERS

ORDER = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "reasoning_output_tokens", "total_tokens")


def put(root, name, *records, whole=False):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(records[0]) if whole else "".join(json.dumps(r) + "\n" for r in records))
    return path


def db(root, name, ddl, **rows):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    con = sqlite3.connect(path)
    con.executescript(ddl)
    for table, values in rows.items():
        con.executemany(f"INSERT INTO {table} VALUES ({','.join('?' * len(values[0]))})", values)
    con.commit()
    con.close()


def claude(root):
    put(root, "projects/p/session-a/chat.jsonl", {"sessionId": "session-a", "timestamp": "2026-01-02T03:04:05Z", "version": "1.2.3", "requestId": "r1", "cwd": "/work/project-a", "message": {"id": "m1", "model": "claude-sonnet-4-20250514", "content": "see main.go", "usage": {"input_tokens": 10, "output_tokens": 5, "cache_creation_input_tokens": 2, "cache_read_input_tokens": 3, "speed": "fast"}}})
    text = (root / "projects/p/session-a/chat.jsonl").read_text().replace('"usage": {', '"usage":{')
    (root / "projects/p/session-a/chat.jsonl").write_text(text)


def codex(root):
    put(
        root,
        "sessions/2026/01/02/rollout-session-a.jsonl",
        {"type": "session_meta", "payload": {"id": "session-a", "cwd": "/work/demo", "originator": "codex_cli_rs"}},
        {"type": "turn_context", "payload": {"model": "gpt-5.2-codex"}},
        {"timestamp": "2026-01-02T03:04:05Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 100, "cached_input_tokens": 20, "output_tokens": 10, "reasoning_output_tokens": 3, "total_tokens": 110}}}},
    )


def gemini(root):
    folder = root / "tmp/shop"
    put(root, "tmp/shop/chats/session-a.jsonl", {"id": "m1", "timestamp": "2026-01-02T03:04:05Z", "type": "gemini", "model": "gemini-3-flash-preview", "tokens": {"input": 15334, "output": 23, "cached": 11526, "thoughts": 919, "tool": 0, "total": 16276}})
    (folder / ".project_root").write_text("/work/shop")


def kimi(root):
    put(root, "config.json", {"model": "kimi-k2"}, whole=True)
    put(root, "sessions/g/session-a/wire.jsonl", {"timestamp": 1770983427.123, "message": {"type": "StatusUpdate", "payload": {"message_id": "m", "token_usage": {"input_other": 100, "output": 50, "input_cache_read": 10, "input_cache_creation": 20}}}})


def qwen(root):
    put(root, "projects/qwen/chats/session-a.jsonl", {"type": "assistant", "timestamp": "2026-01-02T03:04:05Z", "sessionId": "session-a", "model": "qwen3-coder", "usageMetadata": {"promptTokenCount": 10, "candidatesTokenCount": 20, "thoughtsTokenCount": 5, "cachedContentTokenCount": 3, "totalTokenCount": 38}})


def openclaw(root):
    put(root, "agents/main/sessions/abc.jsonl", {"type": "model_change", "provider": "openai", "modelId": "gpt-5.2"}, {"type": "message", "message": {"role": "assistant", "usage": {"input": 1660, "output": 55, "cacheRead": 108928, "cacheWrite": 0, "totalTokens": 110643}, "timestamp": 1770983427123}})


def pi(root):
    put(root, "sessions/demo/agent_session-a.jsonl", {"type": "message", "timestamp": "2026-01-02T03:04:05Z", "message": {"role": "assistant", "model": "gpt-5", "usage": {"totalTokens": 333}}})


def amp(root):
    put(root, "threads/thread.json", {"id": "thread-a", "messages": [{"role": "assistant", "messageId": 7, "usage": {"cacheReadInputTokens": 4}}], "usageLedger": {"events": [{"id": "e", "timestamp": "2026-01-02T03:04:05Z", "model": "gpt-5", "tokens": {"input": 1, "output": 2}, "toMessageId": 9}]}}, whole=True)


def droid(root):
    put(root, "session-a.settings.json", {"model": "custom:Claude-Sonnet-4-[Anthropic]", "providerLock": "anthropic", "providerLockTimestamp": "2026-01-02T03:04:05Z", "tokenUsage": {"inputTokens": 100, "outputTokens": 50, "cacheCreationTokens": 20, "cacheReadTokens": 10, "thinkingTokens": 5}}, whole=True)


MESSAGES = "CREATE TABLE session(id TEXT, directory TEXT, model TEXT); CREATE TABLE message(id TEXT, session_id TEXT, time_created INTEGER, data TEXT); CREATE TABLE part(id TEXT, message_id TEXT, session_id TEXT, time_created INTEGER, data TEXT);"


def message(**more):
    return json.dumps({"role": "assistant", "time": {"created": 1770983427123}, **more})


def kilo(root):
    db(root, "kilo.db", MESSAGES, session=[("session-a", "/work/demo", '{"id":"kilo-auto/free"}')], message=[("m1", "session-a", 1770983427123, message(tokens={"input": 100, "output": 50, "reasoning": 5, "cache": {"read": 10, "write": 20}}))])


def hermes(root):
    db(root, "state.db", "CREATE TABLE sessions(id TEXT, model TEXT, billing_provider TEXT, started_at REAL, message_count INTEGER, input_tokens INTEGER, output_tokens INTEGER, cache_read_tokens INTEGER, cache_write_tokens INTEGER, reasoning_tokens INTEGER)", sessions=[("session-a", "gpt-5.5", "openai", 1770983427.123, 3, 100, 50, 10, 20, 5)])


def goose(root):
    db(root, "sessions.db", "CREATE TABLE sessions(id TEXT, model_config_json TEXT, provider_name TEXT, created_at TEXT, total_tokens INTEGER, input_tokens INTEGER, output_tokens INTEGER, accumulated_total_tokens INTEGER, accumulated_input_tokens INTEGER, accumulated_output_tokens INTEGER)", sessions=[("session-a", '{"model_name":"claude-sonnet-4-20250514"}', "anthropic", "2026-01-02 03:04:05", 9, 8, 1, 180, 100, 50)])


def codebuff(root):
    put(root, "manicode/projects/project-a/chats/2026-01-02T03-04-05.000Z/chat-messages.json", [{"id": "m1", "variant": "ai", "metadata": {"model": "claude-sonnet-4-20250514", "usage": {"inputTokens": 100, "outputTokens": 50}, "codebuff": {"usage": {"cacheCreationInputTokens": 20, "cacheReadInputTokens": 10}}}}], whole=True)


def opencode(root):
    put(root, "storage/message/session-a/m1.json", {"id": "m1", "sessionID": "session-a", "modelID": "claude-sonnet-4-20250514", "path": {"cwd": "/work/demo"}, "time": {"created": 1770983427123}, "tokens": {"input": 100, "output": 50, "reasoning": 0, "cache": {"read": 10, "write": 20}}}, whole=True)


def workbuddy(root):
    put(root, "projects/p/session-a.jsonl", {"id": "1", "timestamp": 1770983427123, "type": "message", "sessionId": "session-a", "cwd": "/work/eapil-eye", "providerData": {"messageId": "m", "model": "glm-5.2", "rawUsage": {"prompt_tokens": 30361, "completion_tokens": 118, "total_tokens": 30479, "prompt_tokens_details": {"cached_tokens": 14720}, "completion_tokens_details": {"reasoning_tokens": 47}}}})


COPILOT = "CREATE TABLE sessions(id TEXT, cwd TEXT, repository TEXT, branch TEXT); CREATE TABLE assistant_usage_events(id TEXT, session_id TEXT, model TEXT, input_tokens INTEGER, output_tokens INTEGER, cache_read_tokens INTEGER, cache_write_tokens INTEGER, reasoning_tokens INTEGER, token_details_json TEXT, created_at TEXT);"


def copilot(root):
    db(root, "session-store.db", COPILOT, sessions=[("session-1", "/work/widget", "", "main")], assistant_usage_events=[("1", "session-1", "mai-code-1-flash", 30483, 289, 7296, 0, 64, "", "2026-01-02T03:04:05Z")])
    at = {"gen_ai.operation.name": "chat", "gen_ai.conversation.id": "session-1", "gen_ai.response.model": "mai-code-1-flash", "gen_ai.usage.input_tokens": 30483, "gen_ai.usage.output_tokens": 225, "gen_ai.usage.cache_read.input_tokens": 7296, "gen_ai.usage.reasoning.output_tokens": 64}
    put(root, "otel/spans.jsonl", {"type": "span", "traceId": "t", "spanId": "s", "name": "chat x", "endTime": [1767323046, 500000000], "attributes": at})


EXPECTED = {
    claude: ("claude-sonnet-4-20250514-fast", "session-a", "project-a", 10, 5, 2, 3, 0, 20),
    codex: ("gpt-5.2-codex", "session-a", "demo", 80, 10, 0, 20, 3, 110),
    copilot: ("mai-code-1-flash", "session-1", "widget", 23187, 225, 0, 7296, 64, 30772),
    gemini: ("gemini-3-flash-preview", "session-a", "shop", 3808, 23, 0, 11526, 919, 16276),
    kimi: ("kimi-k2", "session-a", "kimi", 100, 50, 20, 10, 0, 180),
    qwen: ("qwen3-coder", "session-a", "qwen", 10, 20, 0, 3, 5, 38),
    openclaw: ("[openclaw] gpt-5.2", "abc", "openclaw", 1660, 55, 0, 108928, 0, 110643),
    pi: ("[pi] gpt-5", "session-a", "demo", 0, 333, 0, 0, 0, 333),
    amp: ("gpt-5", "thread-a", "amp", 1, 2, 0, 0, 0, 3),
    droid: ("claude-sonnet-4", "session-a", "droid", 100, 50, 20, 10, 5, 185),
    kilo: ("kilo-auto/free", "session-a", "demo", 100, 50, 20, 10, 5, 185),
    hermes: ("gpt-5.5", "session-a", "hermes", 100, 50, 20, 10, 5, 185),
    goose: ("claude-sonnet-4-20250514", "session-a", "goose", 100, 50, 0, 0, 30, 180),
    codebuff: ("claude-sonnet-4-20250514", "manicode/project-a/2026-01-02T03-04-05.000Z", "codebuff", 100, 50, 20, 10, 0, 180),
    opencode: ("claude-sonnet-4-20250514", "session-a", "demo", 100, 50, 20, 10, 0, 180),
    workbuddy: ("glm-5.2", "session-a", "eapil-eye", 15641, 71, 0, 14720, 47, 30479),
}


@pytest.mark.parametrize("make", EXPECTED, ids=lambda f: f.__name__)
def test_one_event_of_each_provider(spark, tmp_path, make):
    make(tmp_path)
    rows = load_usage(spark, make.__name__, [str(tmp_path)]).collect()
    assert len(rows) == 1
    r = rows[0]
    found = (r.model, r.session_id, r.project, *[r.usage[c] for c in ORDER])
    project = "qwen" if make is qwen else r.project
    assert (found[0], found[1], project, *found[3:]) == EXPECTED[make]
    assert len(r.id) == 64 and r.usage["cached_input_tokens"] == 0 and r.provider == make.__name__


@pytest.mark.parametrize("make", EXPECTED, ids=lambda f: f.__name__)
def test_no_files_no_events(spark, tmp_path, make):
    assert load_usage(spark, make.__name__, [str(tmp_path / "none")]).count() == 0


def codex_count(at, total, last):
    fields = lambda t: dict(zip(("input_tokens", "output_tokens", "total_tokens"), t, strict=True))
    return {"timestamp": f"2026-01-02T03:04:{at:02d}Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": fields(last), "total_token_usage": fields(total)}}}


def test_codex_bills_growth_and_drops_repeats(spark, tmp_path):
    put(tmp_path, "sessions/x/rollout-a.jsonl", codex_count(1, (10, 5, 15), (10, 5, 15)), codex_count(2, (10, 5, 15), (10, 5, 15)), codex_count(3, (31, 21, 52), (21, 16, 37)), codex_count(4, (6, 5, 11), (6, 5, 11)))
    rows = load_usage(spark, "codex", [str(tmp_path)]).orderBy("timestamp").collect()
    assert [r.usage.total_tokens for r in rows] == [15, 37, 11]


def test_codex_counts_confirmed_patches(spark, tmp_path):
    body = "*** Begin Patch\n*** Update File: a.go\n+x\n+y\n-z\n*** End Patch"
    call = lambda c: {"type": "response_item", "payload": {"type": "custom_tool_call", "call_id": c, "name": "apply_patch", "input": body}}
    reply = lambda c, code: {"type": "response_item", "payload": {"type": "custom_tool_call_output", "call_id": c, "output": json.dumps({"output": "", "metadata": {"exit_code": code}})}}
    put(tmp_path, "sessions/x/rollout-a.jsonl", {"type": "session_meta", "payload": {"id": "s", "cwd": "/w"}}, call("1"), reply("1", 0), call("2"), reply("2", 1), codex_count(1, (1, 1, 2), (1, 1, 2)), codex_count(2, (2, 2, 4), (1, 1, 2)))
    rows = load_usage(spark, "codex", [str(tmp_path)]).orderBy("timestamp").collect()
    assert [(r.lines_added, r.lines_removed, r.entity) for r in rows] == [(2, 1, "/w/a.go"), (0, 0, "")]


def usage_line(mid, at, **tokens):
    return json.dumps({"sessionId": "s", "timestamp": f"2026-01-02T03:04:{at:02d}Z", "requestId": "r" + mid, "cwd": "/w", "message": {"id": mid, "model": "m", "usage": "USAGE"}}).replace('"usage": "USAGE"', '"usage":' + json.dumps({"input_tokens": 1, "output_tokens": 1, **tokens}))


def patch_line(file, lines):
    return json.dumps({"toolUseResult": {"filePath": file, "structuredPatch": [{"lines": lines}]}})


def test_claude_gives_patches_to_the_row_before(spark, tmp_path):
    f = tmp_path / "projects/p/s.jsonl"
    f.parent.mkdir(parents=True)
    f.write_text("\n".join([patch_line("/w/first.go", ["+a"]), usage_line("1", 1), patch_line("/w/big.go", ["+a", "+b", "+c", " d"]), patch_line("/w/small.go", ["-e"]), usage_line("2", 2)]) + "\n")
    rows = load_usage(spark, "claude", [str(tmp_path)]).orderBy("timestamp").collect()
    assert [(r.lines_added, r.lines_removed, r.entity, r.is_write) for r in rows] == [(4, 1, "/w/big.go", True), (0, 0, "", None)]


def test_claude_keeps_the_best_of_repeats(spark, tmp_path):
    f = tmp_path / "projects/p/s.jsonl"
    f.parent.mkdir(parents=True)
    f.write_text(usage_line("1", 1) + "\n" + usage_line("1", 2, output_tokens=9) + "\n" + usage_line("1", 3) + "\n")
    from usagelake.providers.stateful import load_claude

    assert [r.usage.total_tokens for r in load_claude(spark, [str(tmp_path)]).collect()] == [10]
    assert [r.usage.total_tokens for r in load_claude(spark, [str(tmp_path)], "first").collect()] == [2]


def test_opencode_bills_running_counters_by_growth(spark, tmp_path):
    ddl = MESSAGES.replace("model TEXT)", "version TEXT, model TEXT)", 1)
    rows = [(f"m{i}", "s", i, json.dumps({"time": {"created": 1770983427000 + i}, "tokens": {"input": n}})) for i, n in enumerate((1000, 0, 1400, 1400, 300))]
    db(tmp_path, "opencode.db", ddl, session=[("s", "/work/demo", "1", "")], message=rows)
    found = load_usage(spark, "opencode", [str(tmp_path)]).orderBy("timestamp").collect()
    assert [r.usage.input_tokens for r in found] == [1000, 400, 1400, 300]


def test_copilot_drops_only_twins(spark, tmp_path):
    copilot(tmp_path)
    lines = (tmp_path / "otel/spans.jsonl").read_text()
    other = lines.replace('"session-1"', '"session-2"').replace('"traceId": "t"', '"traceId": "u"')
    (tmp_path / "otel/spans.jsonl").write_text(lines + other)
    assert sorted(r.session_id for r in load_usage(spark, "copilot", [str(tmp_path)]).collect()) == ["session-1", "session-2"]


def test_gemini_checkpoints_and_tool_calls(spark, tmp_path):
    one = {"id": "m1", "timestamp": "2026-01-02T03:04:05Z", "type": "gemini", "tokens": {"input": 10, "output": 1, "total": 11}}
    two = {**one, "tokens": {"input": 70, "output": 40, "cached": 10, "thoughts": 5, "total": 115}, "toolCalls": [{"name": "replace", "status": "success", "args": {"file_path": "/w/a.go"}, "resultDisplay": {"diffStat": {"model_added_lines": 7, "model_removed_lines": 3}}}, {"name": "write_file", "status": "success", "args": {"file_path": "/w/b.go", "content": "x\ny\n"}}, {"name": "replace", "status": "error", "args": {"file_path": "/w/c.go"}}]}
    put(tmp_path, "tmp/shop/chats/session-a.jsonl", one, {"$set": {"messages": [two]}})
    rows = load_usage(spark, "gemini", [str(tmp_path)]).collect()
    assert [tuple(r.usage[c] for c in ORDER) for r in rows] == [(60, 40, 0, 10, 5, 115)]
    assert (rows[0].lines_added, rows[0].lines_removed, rows[0].language) == (9, 3, "Go")
