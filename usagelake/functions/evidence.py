"""Languages from paths that records tell of.

Paths anywhere in nested JSON (Claude, Codex): nesting has no bound, which column expressions can't follow, so those are
found by a pandas UDF over the JSON text. Paths at known places (all others) are column expressions: arrays of path and weight,
of which operators.files.dominant_language picks the language.
"""

from __future__ import annotations

import json
import os.path
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake.functions import variants as v
from usagelake.functions.language import EXTENSIONS, FILE_NAMES, HEADER_LANGUAGES, PATH_IN_TEXT, UNKNOWN, language_of, paths_from_text

FIND = re.compile(PATH_IN_TEXT)


def language_name(path: str) -> str:
    """As language.language_of, with ".h" for headers."""
    name = os.path.basename(path.strip().strip("\"'").rstrip("/")).lower()
    ending = os.path.splitext("x" + name)[1] if name.count(".") else ""
    return FILE_NAMES.get(name) or (".h" if ending == ".h" else EXTENSIONS.get(ending, UNKNOWN))


def text_paths(text: str) -> list[str]:
    found = (re.sub(r"[)\]}]+$", "", re.sub(r"[.,:]+$", "", m.strip().strip("\"'"))) for m in FIND.findall(text))
    return [p for p in dict.fromkeys(found) if p and language_name(p) != UNKNOWN]


@dataclass(frozen=True)
class Rules:
    """How a provider's records tell paths: by keys that name files and keys that name text, and by weight."""

    is_text: Callable[[str], bool]
    path_bonus: int = 0
    text_weight: int | None = 1  #: None: the weight of the surroundings
    everywhere: bool = False  #: other keys are entered, and strings and keys that are paths count


def evidence(value: object, weight: int, rules: Rules, key: str = "") -> Iterator[tuple[str, int]]:
    """(path, weight) pairs of a value that stands under key."""
    name = key.lower()
    text_weight = weight if rules.text_weight is None else rules.text_weight
    if name and ("file" in name or "path" in name):
        yield from under_path(value, weight + rules.path_bonus, rules)
    elif name and rules.is_text(name):
        if isinstance(value, str):
            yield from ((p, text_weight) for p in text_paths(value))
    elif isinstance(value, dict) and (rules.everywhere or not name):
        for k, child in value.items():
            if rules.everywhere and language_name(k) != UNKNOWN:
                yield k, weight
            yield from evidence(child, weight, rules, k)
    elif isinstance(value, list) and (rules.everywhere or not name):
        for child in value:
            yield from evidence(child, weight, rules)
    elif isinstance(value, str) and rules.everywhere and language_name(value) != UNKNOWN:
        yield value, weight


def under_path(value: object, weight: int, rules: Rules) -> Iterator[tuple[str, int]]:
    if isinstance(value, str):
        yield from [(value, weight)] if language_name(value) != UNKNOWN else ((p, 1) for p in text_paths(value))
    elif isinstance(value, list):
        for child in value:
            yield from under_path(child, weight, rules)
    else:
        yield from evidence(value, weight, rules)


def dominant(candidates: list[tuple[str, int]]) -> str:
    score: Counter = Counter()
    for path, weight in candidates:
        score[language_name(path)] += max(1, weight)
    score.pop(UNKNOWN, None)
    headers = score.pop(".h", 0)
    if headers:
        score[max(HEADER_LANGUAGES, key=lambda x: (score[x], -HEADER_LANGUAGES.index(x))) if any(score[x] for x in HEADER_LANGUAGES) else "C"] += headers
    return min(score, key=lambda x: (-score[x], x)) if score else UNKNOWN


CLAUDE = Rules(lambda k: "command" in k or "content" in k or "query" in k)
GENERIC = Rules(lambda k: "command" in k or k == "cmd" or "query" in k or "content" in k, path_bonus=2, text_weight=None, everywhere=True)


def of_claude(content: object) -> list[tuple[str, int]]:
    if isinstance(content, str):
        return [(p, 1) for p in text_paths(content)]
    out: list[tuple[str, int]] = []
    for block in content if isinstance(content, list) else []:
        if isinstance(block, dict):
            if block.get("type") == "tool_use" and isinstance(block.get("input"), dict):
                out += evidence(block["input"], 3, CLAUDE)
            if isinstance(block.get("text"), str):
                out += [(p, 1) for p in text_paths(block["text"])]
    return out


def of_payload(payload: object) -> list[tuple[str, int]]:
    """Any record; strings under arguments or input that are JSON themselves weigh more."""
    out = list(evidence(payload, 1, GENERIC))
    for name in ("arguments", "input"):
        inner = payload.get(name) if isinstance(payload, dict) else None
        if isinstance(inner, str):
            try:
                out += evidence(json.loads(inner), 3, GENERIC)
            except ValueError:
                out += [(p, 1) for p in text_paths(inner)]
    return out


def language_udf(candidates: Callable[[object], list[tuple[str, int]]]):
    """The dominant language of JSON texts; Unknown for null and malformed ones."""

    @F.pandas_udf("string")
    def languages(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for text in part:
                try:
                    out.append(dominant(candidates(json.loads(text))) if text else UNKNOWN)
                except ValueError:
                    out.append(UNKNOWN)
            yield pd.Series(out, index=part.index, dtype=object)

    return languages


WEIGHED = "array<struct<path:string,weight:int>>"
# Weights of a changed file, of one that was read, and of one that a text names.
CHANGED, READ, TOLD = 4, 2, 1


def weighed(paths: Column, weight: int) -> Column:
    return F.transform(paths, lambda p: F.struct(p.alias("path"), F.lit(weight).alias("weight")))


def told(text: Column) -> Column:
    return weighed(paths_from_text(text), TOLD)


def of_arguments(arguments: Column, either: bool) -> Column:
    """Paths of a tool's arguments (a variant): a path under a key that names files weighs 3, those in a text under a key that names
    text 1. either: a key that names files but holds no known path may be one that names text."""

    def one(entry: Column) -> Column:
        key, said = F.lower(entry["key"]), v.text(entry["value"], "$")
        names = key.contains("path") | key.contains("file")
        speaks = key.contains("command") | key.contains("content") | key.contains("query")
        known = language_of(said) != UNKNOWN
        return F.when(names & known, weighed(F.array(said), 3)).when(speaks & (F.lit(True) if either else ~names), told(said)).otherwise(F.array().cast(WEIGHED))

    entries = F.map_entries(F.coalesce(F.try_variant_get(arguments, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    return F.flatten(F.transform(entries, one))
