"""Scans of several providers, and what they count."""

import json

from usagelake.plans.scan import Counts, scan, scan_order
from usagelake.plans.store import GenerationStore
from usagelake.providers.base import REGISTRY, Provider


def pi(n):
    return json.dumps({"type": "message", "timestamp": f"2026-01-02T03:04:{n:02d}Z", "message": {"role": "assistant", "model": "x", "usage": {"input": n, "output": 1}}}) + "\n"


def qwen(n):
    return json.dumps({"type": "assistant", "timestamp": f"2026-01-02T03:04:{n:02d}Z", "sessionId": "s", "model": "q", "usageMetadata": {"promptTokenCount": n}}) + "\n"


def test_scan_order_is_that_of_registration():
    names = list(REGISTRY)
    asked = {"zeta": ["/z"], names[3]: ["/c"], names[1]: ["", "/a"], names[2]: [""], "alpha": ["/b"], "none": []}
    assert scan_order(asked) == [names[1], names[3], "alpha", "zeta"]


def test_a_scan_counts_what_it_parses_and_inserts(spark, tmp_path, monkeypatch):
    def broken(spark, paths):
        raise OSError("unreadable")

    monkeypatch.setitem(REGISTRY, "broken", Provider("broken", broken))
    store = GenerationStore(spark, str(tmp_path / "queue"))
    (tmp_path / "a" / "demo").mkdir(parents=True)
    (tmp_path / "q" / "projects" / "p" / "chats").mkdir(parents=True)
    log, chat = tmp_path / "a" / "demo" / "agent_s.jsonl", tmp_path / "q" / "projects" / "p" / "chats" / "c.jsonl"
    log.write_text("".join(pi(n) for n in (1, 2, 3, 3)) + "not json\n")
    chat.write_text(qwen(5))
    dirs = {"pi": [str(tmp_path / "a"), ""], "qwen": [str(tmp_path / "q")], "unheard": ["/x"], "broken": ["/x"], "kimi": [str(tmp_path / "absent")]}
    first = scan(spark, store, dirs)
    assert first.counts["pi"] == Counts(4, 4) and first.counts["qwen"] == Counts(1, 1) and first.counts["kimi"] == Counts(0, 0)
    assert set(first.errors) == {"unheard", "broken"} and "unreadable" in first.errors["broken"]
    log.write_text(log.read_text() + pi(4))
    again = scan(spark, store, {"pi": dirs["pi"]}, identity=None)
    assert again.counts == {"pi": Counts(5, 1)} and not again.errors
    assert store.read().count() == 6
