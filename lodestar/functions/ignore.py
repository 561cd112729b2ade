"""Ignore files: which paths their patterns leave out. The syntax is the one git documents for its ignore files."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The patterns that hold where a project has no ignore file.
DEFAULT_PATTERNS = [
    "node_modules/", ".venv/", "venv/", "env/", "__pycache__/", ".tox/", ".nox/", ".pytest_cache/", ".mypy_cache/", ".ruff_cache/", "vendor/", "Pods/",
    "dist/", "build/", "out/", "target/", "*.egg-info/", "*.whl", "*.pyc", "*.pyo",
    "*.so", "*.dylib", "*.dll", "*.exe", "*.bin", "*.o", "*.a", "*.lib",
    ".idea/", ".vscode/", "*.swp", "*.swo", "*~",
    ".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "credentials.*", "secrets.*",
    ".git/", ".hg/", ".svn/",
    ".DS_Store", "Thumbs.db",
]

TOKEN = re.compile(r"\\(.)|\[([!^]?)(\]?[^\]]*)\]|(.)", re.S)


def segment(glob: str) -> str:
    """The regular expression of one part of a path; stars and question marks never match a slash."""

    def one(m: re.Match) -> str:
        quoted, negated, members, char = m.groups()
        if members is not None:
            inside = re.sub(r"([\\\[\]&^])", r"\\\1", members)
            return f"[^/{inside}]" if negated else f"[{inside}]"
        return {"*": "[^/]*", "?": "[^/]"}.get(char) or re.escape(quoted or char)

    return TOKEN.sub(one, glob)


def parsed(line: str) -> tuple[bool, str] | None:
    """(ignores, regular expression for relative paths of files) of a line; None for a comment or an empty one."""
    line = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    ignores = not line.startswith("!")
    glob = line if ignores else line[1:]
    folder, parts = glob.endswith("/"), glob.strip("/").split("/")
    if not parts[0]:
        return None
    anchored = glob.startswith("/") or len(parts) > 1
    expression = "^" if anchored else "^(?:.*/)?"
    for at, part in enumerate(parts):
        last = at == len(parts) - 1
        if part == "**":
            expression += ".+" if last else "(?:[^/]+/)*"
        else:
            expression += ("[^/]+" if part == "*" else segment(part)) + ("" if last else "/")
    return ignores, expression + ("/.*$" if folder else "(?:/.*)?$")


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """The last pattern that matches the relative path leaves it out, or with ``!`` takes it in again. Null path: null.
    Neighbouring patterns of one kind are one expression."""
    out = F.lit(False)
    for ignores, same in groupby(filter(None, map(parsed, patterns)), key=lambda p: p[0]):
        out = F.when(path.rlike("|".join(f"(?:{e})" for _, e in same)), ignores).otherwise(out)
    return F.when(path.isNotNull(), out)


def patterns_of(spark: SparkSession, file: str | None) -> list[str]:
    """The lines of an ignore file; the default patterns without one."""
    return DEFAULT_PATTERNS if file is None else [r[0] for r in spark.read.text(file).collect()]
