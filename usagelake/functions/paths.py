"""Lexical path functions as column expressions: no file system is asked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake.functions.binding import let


#: Paths that aren't as short as they can be; the others needn't be taken apart.
UNCLEAN = r"^$|//|(^|/)\.\.?(/|$)|[^/]/$"


def is_absolute(path: Column) -> Column:
    return path.startswith("/")


def clean(path: Column) -> Column:
    """The shortest equal path: no empty or "." parts, ".." resolved where it can be; "" becomes "."."""
    return let(path, lambda p: F.when(p.rlike(UNCLEAN), _clean(p)).otherwise(p))


def _clean(path: Column) -> Column:
    rooted = is_absolute(path)
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) == 0, F.when(rooted, done).otherwise(F.array(F.lit("..")))).when(F.element_at(done, -1) == "..", F.concat(done, F.array(F.lit("..")))).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def join(parent: Column, child: Column) -> Column:
    """Clean path of child under parent; empty parts are skipped, and all empty give ""."""
    both = F.array_join(F.filter(F.array(parent, child), lambda x: x != ""), "/")
    return let(both, lambda p: F.when(p == "", F.lit("")).otherwise(_clean(p)))


def base(path: Column) -> Column:
    """Last element, without trailing slashes; "" gives ".", only slashes give "/"."""
    last = lambda p: F.element_at(F.split(F.regexp_replace(p, "/+$", ""), "/"), -1)
    return let(path, lambda p: F.when(p == "", F.lit(".")).when(last(p) == "", F.lit("/")).otherwise(last(p)))


def parent(path: Column) -> Column:
    """The clean path of all but the last element."""
    return clean(F.when(path.contains("/"), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.lit("")))


def extension(path: Column) -> Column:
    """From the last dot of the last element on; "" without one."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def relative(root: Column, path: Column) -> Column:
    """path seen from root, both absolute or both relative; with ".." parts where it lies elsewhere."""
    return let(F.struct(root.alias("r"), path.alias("p")), lambda s: _relative(s["r"], s["p"]))


def _relative(root: Column, path: Column) -> Column:
    a, b = F.filter(F.split(clean(root), "/"), lambda x: ~x.isin("", ".")), F.filter(F.split(clean(path), "/"), lambda x: ~x.isin("", "."))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: _steps(s["a"], s["b"]))


def _steps(a: Column, b: Column) -> Column:
    shorter = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.sequence(F.lit(0), shorter), F.lit(0), lambda n, i: F.when((i == n) & (i < shorter) & (F.try_element_at(a, i + 1) == F.try_element_at(b, i + 1)), n + 1).otherwise(n))
    parts = let(same, lambda n: F.concat(F.array_repeat(F.lit(".."), F.size(a) - n), F.slice(b, n + 1, F.size(b))))
    return let(parts, lambda p: F.when(F.size(p) == 0, F.lit(".")).otherwise(F.array_join(p, "/")))


def ancestors(path: Column) -> Column:
    """The clean path's directories from itself up to "/"; an empty array for "" and relative paths."""
    up = lambda parts: F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    none = F.array().cast("array<string>")
    return F.when(is_absolute(path), let(F.filter(F.split(clean(path), "/"), lambda x: x != ""), up)).otherwise(none)


def resolve_path(cwd: Column, path: Column) -> Column:
    return let(F.trim(path), lambda p: F.when(p == "", F.lit("")).when(is_absolute(p), _clean(p)).when(F.trim(cwd) == "", p).otherwise(join(cwd, p)))


def project_from_cwd(cwd: Column) -> Column:
    """struct(project, project_path) of an absolute working directory other than the root, else empty."""
    usable = lambda p: is_absolute(p) & (p != "/")
    return let(clean(F.trim(cwd)), lambda p: F.struct(F.when(usable(p), base(p)).otherwise(F.lit("")).alias("project"), F.when(usable(p), p).otherwise(F.lit("")).alias("project_path")))


def relative_entity(project_path: Column, entity: Column) -> Column:
    """The entity inside its project; its bare name where it lies outside or no project is known."""
    both = F.struct(F.trim(project_path).alias("r"), F.trim(entity).alias("p"))
    return let(both, lambda s: let(_relative(s["r"], s["p"]), lambda inside: _entity(s["r"], s["p"], inside)))


def _entity(root: Column, path: Column, inside: Column) -> Column:
    able = (root != "") & (is_absolute(root) == is_absolute(path)) & (inside != "..") & ~inside.startswith("../")
    return F.when(path == "", F.lit("")).when(able, inside).otherwise(base(path))
