"""Programming languages of paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake.functions.binding import let
from usagelake.functions.paths import base, extension

UNKNOWN = "Unknown"

# Language of a file name (lower case).
FILE_NAMES = {
    ".bashrc": "Bash",
    ".bash_history": "Bash",
    ".gvimrc": "VimL",
    ".htaccess": "Apache Config",
    ".rhistory": "S",
    ".renviron": "S",
    ".rprofile": "S",
    ".ruby-version": "Ruby",
    ".vimrc": "VimL",
    ".zshrc": "Bash",
    "buck": "Python",
    "build": "Python",
    "build.bazel": "Python",
    "cmakelists.txt": "CMake",
    "dockerfile": "Docker",
    "gemfile": "Ruby",
    "go.mod": "Go",
    "go.sum": "Go",
    "gnumakefile": "Makefile",
    "gruntfile": "JavaScript",
    "makefile": "Makefile",
    "pipfile": "TOML",
    "pkgbuild": "Bash",
    "poetry.lock": "TOML",
    "rakefile": "Ruby",
    "sconscript": "Python",
    "sconstruct": "Python",
    "vimrc": "VimL",
    "workspace": "Python",
    "workspace.bazel": "Python",
    "zshrc": "Bash",
}

# Language of an extension (lower case); ".h" is decided by its neighbours.
EXTENSIONS = {
    ".abap": "ABAP",
    ".adb": "Ada",
    ".ads": "Ada",
    ".agda": "Agda",
    ".applescript": "AppleScript",
    ".astro": "Astro",
    ".awk": "Awk",
    ".bash": "Bash",
    ".bat": "Batchfile",
    ".bats": "Bash",
    ".bazel": "Python",
    ".bzl": "Python",
    ".c": "C",
    ".c++": "C++",
    ".cabal": "Cabal Config",
    ".cc": "C++",
    ".cfg": "INI",
    ".clj": "Clojure",
    ".cljs": "ClojureScript",
    ".cmake": "CMake",
    ".coffee": "CoffeeScript",
    ".conf": "INI",
    ".cpp": "C++",
    ".cr": "Crystal",
    ".cs": "C#",
    ".css": "CSS",
    ".csv": "CSV",
    ".cxx": "C++",
    ".dart": "Dart",
    ".docker": "Docker",
    ".dpr": "Object Pascal",
    ".dts": "Devicetree",
    ".dtsi": "Devicetree",
    ".eex": "Elixir",
    ".el": "EmacsLisp",
    ".elm": "Elm",
    ".erl": "Erlang",
    ".ex": "Elixir",
    ".exs": "Elixir",
    ".fs": "F#",
    ".fsi": "F#",
    ".gemspec": "Ruby",
    ".go": "Go",
    ".gradle": "Groovy",
    ".graphql": "GraphQL",
    ".groovy": "Groovy",
    ".gsp": "Gosu",
    ".gs": "Gosu",
    ".h++": "C++",
    ".haml": "Haml",
    ".hh": "C++",
    ".hpp": "C++",
    ".hrl": "Erlang",
    ".hs": "Haskell",
    ".html": "HTML",
    ".htm": "HTML",
    ".hxx": "C++",
    ".i": "SWIG",
    ".ini": "INI",
    ".java": "Java",
    ".jl": "Julia",
    ".js": "JavaScript",
    ".json": "JSON",
    ".jsonl": "JSON",
    ".jsx": "JSX",
    ".kt": "Kotlin",
    ".kts": "Kotlin",
    ".less": "Less",
    ".liquid": "Liquid",
    ".lua": "Lua",
    ".m": "Objective-C",
    ".markdown": "Markdown",
    ".md": "Markdown",
    ".mdx": "MDX",
    ".mjs": "JavaScript",
    ".ml": "OCaml",
    ".mli": "OCaml",
    ".mm": "Objective-C++",
    ".nix": "Nix",
    ".pas": "Object Pascal",
    ".pbxproj": "Xcode Project",
    ".php": "PHP",
    ".php3": "PHP",
    ".php4": "PHP",
    ".php5": "PHP",
    ".pl": "Perl",
    ".pm": "Perl",
    ".prisma": "Prisma",
    ".pro": "Prolog",
    ".proto": "Protocol Buffer",
    ".ps1": "PowerShell",
    ".psm1": "PowerShell",
    ".pug": "Pug",
    ".py": "Python",
    ".pyw": "Python",
    ".qml": "QML",
    ".r": "S",
    ".rake": "Ruby",
    ".rb": "Ruby",
    ".re": "ReasonML",
    ".rei": "ReasonML",
    ".rs": "Rust",
    ".rst": "ReStructuredText",
    ".sass": "Sass",
    ".scala": "Scala",
    ".scm": "Scheme",
    ".scss": "SCSS",
    ".sh": "Bash",
    ".sql": "SQL",
    ".sublime-settings": "Sublime Text Config",
    ".svelte": "Svelte",
    ".sv": "SystemVerilog",
    ".svh": "SystemVerilog",
    ".swift": "Swift",
    ".toml": "TOML",
    ".ts": "TypeScript",
    ".tsx": "TypeScript",
    ".twig": "Twig",
    ".txt": "Text",
    ".vb": "VB.Net",
    ".vcl": "VCL",
    ".vim": "VimL",
    ".vue": "Vue.js",
    ".xaml": "XAML",
    ".xml": "XML",
    ".yaml": "YAML",
    ".yml": "YAML",
    ".zig": "Zig",
    ".zsh": "Bash",
}

# Languages that a header can belong to, the earlier one on a tie.
HEADER_LANGUAGES = ("C++", "C", "Objective-C", "Objective-C++")

# Fixed value: a path with an extension in running text, after a blank, quote or opening bracket.
PATH_IN_TEXT = r"(?i)(?:^|[\s\"'`(\[{<])([~./A-Z0-9_@{}$%:+,-][^\s\"'`(){}\[\]<>|;]*\.(?:[A-Z0-9_+-]{1,16})(?:\b|$))"


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def normalized_base(path: Column) -> Column:
    return F.lower(base(F.regexp_replace(F.trim(path), "^[\"']+|[\"']+$", "")))


def is_header(path: Column) -> Column:
    return extension(normalized_base(path)) == ".h"


def language_of(path: Column) -> Column:
    """By file name first, then by extension; a header counts as C here."""
    known = lambda name: F.coalesce(F.try_element_at(_lookup(FILE_NAMES), name), F.try_element_at(_lookup({**EXTENSIONS, ".h": "C"}), extension(name)), F.lit(UNKNOWN))
    return let(normalized_base(path), known)


def clean_path_token(token: Column) -> Column:
    bare = F.regexp_replace(F.trim(token), "^[\"']+|[\"']+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[.,:]+$", ""), r"[)\]}]+$", "")


def paths_from_text(text: Column) -> Column:
    """Distinct paths in order of appearance, only those of a known language."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(PATH_IN_TEXT), F.lit(1)), clean_path_token)
    return F.array_distinct(F.filter(tokens, lambda p: (p != "") & (language_of(p) != UNKNOWN)))
