"""Text normalisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake.functions.binding import let

UNKNOWN = "Unknown"

# Names of operating systems and of the clients that providers report.
SYSTEMS = {"darwin": "macOS", "windows": "Windows", "linux": "Linux"}
CLIENTS = {
    "claude": {"claude-vscode": "VS Code", "claude-desktop": "Claude Desktop", "sdk-cli": "Claude CLI", "cli": "Claude CLI", "sdk-ts": "Claude SDK", "sdk-py": "Claude SDK", "sdk-python": "Claude SDK"},
    "codex": {"codex_vscode": "VS Code", "codex desktop": "Codex Desktop", "codex-desktop": "Codex Desktop", "codex_cli_rs": "Codex CLI", "codex_cli": "Codex CLI", "cli": "Codex CLI"},
}


def first_non_empty(*values: Column) -> Column:
    """The first value that isn't blank, trimmed; "" if none is."""
    return F.coalesce(*[let(F.trim(v), lambda x: F.when(x != "", x)) for v in values], F.lit(""))


def normalize_project(project: Column) -> Column:
    return let(F.trim(F.coalesce(project, F.lit(""))), lambda name: F.when(F.lower(name).isin("", "unknown"), F.lit(UNKNOWN)).otherwise(name))


def normalize_language(language: Column) -> Column:
    return F.coalesce(let(F.trim(language), lambda x: F.when(x != "", x)), F.lit(UNKNOWN))


def _named(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def normalize_os(system: Column) -> Column:
    return F.coalesce(_named(SYSTEMS, system), system)


def normalize_client(provider: Column, token: Column) -> Column:
    """A product's name for the token a provider reports; unknown tokens stay, trimmed."""
    known = lambda t: F.coalesce(*[F.when(provider == p, _named(names, F.lower(t))) for p, names in CLIENTS.items()], t)
    return let(F.trim(token), known)


def count_lines(content: Column) -> Column:
    """Lines of a text; an ending line feed adds none."""
    feeds = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return let(content, lambda c: F.when(c == "", F.lit(0)).otherwise(feeds(c) + F.when(c.endswith("\n"), 0).otherwise(1)).cast("long"))


def is_semver_prefix(version: Column) -> Column:
    return version.rlike(r"^\d+\.\d+\.\d")


def hash_project_path(path: Column) -> Column:
    trimmed = F.trim(path)
    return F.when(trimmed == "", F.lit("")).otherwise(F.sha2(trimmed, 256))


def sorted_distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v != "")))
