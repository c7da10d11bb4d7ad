"""Which paths of a source tree are left out."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Directories that are always left out, and the name of a tree's own list.
SKIPPED = (
    ".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", "coverage", "tmp", "cache", ".nx",
    "lcov-report",
)
IGNORE_FILE = ".ccignore"


def patterns_of(text: str) -> list[str]:
    """The patterns in an ignore list: comments, blanks and closing slashes are dropped."""
    found = (line.partition("#")[0].strip().rstrip("/") for line in text.splitlines())
    return [p for p in found if p]


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isFile())


def load_patterns(spark: SparkSession, root: str) -> list[str]:
    """The patterns of a tree's own list, in any store; none if there is no list."""
    path = f"{root.rstrip('/')}/{IGNORE_FILE}"
    if not is_file(spark, path):
        return []
    # a name that begins with a dot is hidden from Spark's readers
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return patterns_of(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _class(inside: str, char: str) -> str:
    """What stands between brackets as a regular expression of one character; descending ranges are empty."""
    negative, inside = inside.startswith("!"), inside.removeprefix("!")
    parts, i = "", 0
    while i < len(inside):
        if inside[i + 1 : i + 2] == "-" and i + 2 < len(inside):
            low, high = inside[i], inside[i + 2]
            parts += f"{_plain(low)}-{_plain(high)}" if low <= high else ""
            i += 3
        else:
            parts += _plain(inside[i])
            i += 1
    if not parts:
        return char if negative else "(?!)"
    return ("" if char == "." else "(?!/)") + f"[{'^' if negative else ''}{parts}]"


def _plain(c: str) -> str:
    return c if c.isalnum() else f"\\x{{{ord(c):x}}}" if ord(c) > 255 else f"\\x{ord(c):02x}"


def _glob(pattern: str, char: str) -> str:
    """A shell pattern as a regular expression whose wildcards match what ``char`` does: ``.``, or ``[^/]``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        first = i + pattern[i : i + 1].count("!")
        end = pattern.find("]", first + 1) if c == "[" else -1
        if c == "*":
            out += char + "*"
        elif c == "?":
            out += char
        elif c == "[" and end > 0:
            out += _class(pattern[i:end], char)
            i = end + 1
        else:
            out += re.escape(c)
    return out


def regex_of(pattern: str) -> str:
    """A pattern as one regular expression over a whole path, for Python and for Java alike.

    One without a slash also matches any part of the path, and then nothing in it matches a
    slash; what matches a directory also matches all below it.
    """
    anywhere = "" if "/" in pattern else f"|(?:.*/)?{_glob(pattern, '[^/]')}(?:/.*)?"
    return f"(?s)^(?:{_glob(pattern, '.')}(?:/.*)?{anywhere})$"


def ignored(path: Column, patterns: list[str], skip=SKIPPED) -> Column:
    """Whether a path is left out, as a native expression."""
    clean = F.btrim(path, F.lit("/"))
    out = F.arrays_overlap(F.split(clean, "/"), F.array(*map(F.lit, skip))) if skip else F.lit(False)
    for p in patterns:
        out = out | clean.rlike(regex_of(p))
    return out


def folders(spark: SparkSession, root: str, patterns: list[str] | None = None, skip=SKIPPED) -> list[str]:
    """Relative paths of the folders that count, empty ones too; those left out aren't entered.

    Listed in the driver, as no reader of tables shows folders: a name for each folder.
    """
    rules = [re.compile(regex_of(p)) for p in (load_patterns(spark, root) if patterns is None else patterns)]
    fs, p = _at(spark, root)
    found, waiting = [], [("", p)] if fs.exists(p) else []
    while waiting:
        prefix, at = waiting.pop()
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            if status.isDirectory() and name not in skip and not any(r.match(prefix + name) for r in rules):
                found.append(prefix + name)
                waiting.append((f"{prefix}{name}/", status.getPath()))
    return sorted(found)
