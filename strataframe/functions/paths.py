"""Names of files and layers: parts of paths as Columns, relative and absolute paths, free names, texts of several JSON objects."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


def title(path: Column) -> Column:
    """File name without folder and extension."""
    name = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    """Without the dot; empty where there is none."""
    return F.regexp_extract(path, r"\.([^./\\]*)$", 1)


def with_extension(path: Column, ext: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit(f".{ext}"))


def _folders(path: Column) -> Column:
    return F.split(F.regexp_replace(path, r"/[^/]*$", ""), "/")


def relative(base: Column, target: Column) -> Column:
    """The target as seen from the folder that holds the file ``base``."""
    a, b = _folders(base), F.split(target, "/")
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b) - 1)), lambda n: F.slice(a, 1, n) == F.slice(b, 1, n)))
    up = F.repeat(F.lit("../"), F.size(a) - same)
    return F.concat(up, F.array_join(F.slice(b, same + 1, F.size(b)), "/"))


def absolute(base: Column, rel: Column) -> Column:
    """A path given from the folder that holds the file ``base``, without . and .. parts."""
    parts = F.filter(F.concat(_folders(base), F.split(rel, "/")), lambda p: p != ".")
    empty = F.slice(parts, 1, 0)
    step = lambda done, p: F.when((p == "..") & (F.size(done) > 1), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, empty, step), "/")


def relative_path(base: str, target: str) -> str:
    """The same of plain texts."""
    return posixpath.relpath(target, posixpath.dirname(base) or ".")


def absolute_path(base: str, rel: str) -> str:
    if "://" in rel:
        return rel
    head, mark, tail = base.partition("://")
    folder = posixpath.dirname(tail if mark else base)
    return f"{head}{mark}" * bool(mark) + posixpath.normpath(posixpath.join(folder, rel))


def free_name(name: str, names: list[str]) -> str:
    """The name, or the name with the first number of three digits that makes it differ from all others, in any case."""
    taken = {n.lower() for n in names}
    if name.lower() not in taken:
        return name
    for n in range(1, 10**9):
        if f"{name}{n:03d}".lower() not in taken:
            return f"{name}{n:03d}"
    raise ValueError("no free name")


def json_objects(text: str) -> list[str]:
    """Texts of the outermost JSON objects that stand one after the other; brackets in strings do not count."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def progress(done: int, total: int, seconds: float) -> tuple[int, float, float]:
    """(percent, per second, seconds to go)."""
    speed = done / seconds if seconds > 0 else 0.0
    return (done * 100 // total if total else 100), speed, ((total - done) / speed if speed else float("inf"))
