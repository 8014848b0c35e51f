"""Glob, LIKE, ignore-rule and target-path patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def glob_to_regex(glob: str) -> str:
    """An anchored regular expression: ``*`` is any text, ``?`` any character, all else itself."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def glob_to_like(glob: str, compat: bool = False) -> str:
    """A LIKE pattern with backslash escapes; with ``compat`` % and _ stay wildcards."""
    out = glob if compat else re.sub(r"([\\%_])", r"\\\1", glob)
    return out.replace("*", "%").replace("?", "_")


def name_like(column: Column, glob: str, compat: bool = False) -> Column:
    """Whether a name matches a glob, whatever the case."""
    return F.lower(column).like(glob_to_like(glob.lower(), compat))


def path_like(column: Column, glob: str, compat: bool = False) -> Column:
    """Whether a path contains a glob, whatever the case; with ``compat`` all but ``*`` and ``?`` is a regular expression."""
    inner = glob.replace("*", ".*").replace("?", ".") if compat else glob_to_regex(glob)[1:-1]
    return column.rlike("(?i)^.*" + inner + ".*$")


@dataclass(frozen=True)
class Rule:
    """One ignore rule: a glob for each level; a directory rule's last one ends with a slash."""

    levels: tuple[str, ...]

    @property
    def for_directory(self) -> bool:
        return self.levels[-1].endswith("/")

    def regex(self) -> str:
        """Matches the relative paths, directories with a slash at the end, that the rule names, and all below them."""
        parts = [glob_to_regex(level.rstrip("/"))[1:-1].replace(".*", "[^/]*") for level in self.levels]
        return "^" + "/".join(parts) + ("/.*$" if self.for_directory else "$")


def parse_rules(lines: Iterable[str]) -> list[Rule]:
    """The rules of an ignore file: blank lines and comments are left out."""
    rules = []
    for line in lines:
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        body, slash = (text[:-1], "/") if text.endswith("/") else (text, "")
        levels = body.split("/")
        levels[-1] += slash
        rules.append(Rule(tuple(levels)))
    return rules


def ignored(path: Column, rules: Iterable[Rule]) -> Column:
    """Whether a relative path is named by a rule or lies in a directory that is."""
    found = F.lit(False)
    for rule in rules:
        # A rule with a leading slash has an empty first level, which no name matches.
        if rule.levels[0] != "":
            found = found | path.rlike(rule.regex())
    return found


def read_rules(lines: DataFrame) -> DataFrame:
    """The rule lines (value) of ignore files as text rows."""
    text = F.trim("value")
    return lines.select(text.alias("rule")).where((F.col("rule") != "") & ~F.col("rule").startswith("#"))


_DATE_TOKENS = {"yyyy": "%Y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}


def target_path(pattern: str, now: datetime) -> str:
    r"""A target with each ``[date pattern]`` filled in; ``\[`` and ``\]`` are brackets."""

    def date(m: re.Match) -> str:
        return re.sub("yyyy|MM|dd|HH|mm|ss", lambda t: now.strftime(_DATE_TOKENS[t[0]]), m[1])

    filled = re.sub(r"(?<!\\)\[([^\]]*?)(?<!\\)\]", date, pattern)
    return filled.replace("\\[", "[").replace("\\]", "]")


def target_paths(pattern: str, time: Column) -> Column:
    """``target_path`` with the date of each row; any letters that Spark's date patterns know may stand in the brackets."""
    parts, at = [], 0
    for m in re.finditer(r"(?<!\\)\[([^\]]*?)(?<!\\)\]", pattern):
        parts += [F.lit(pattern[at : m.start()]), F.date_format(time, m[1])]
        at = m.end()
    plain = F.concat(*parts, F.lit(pattern[at:]))
    return F.replace(F.replace(plain, F.lit("\\["), F.lit("[")), F.lit("\\]"), F.lit("]"))


@dataclass(frozen=True)
class Target:
    """A target path and what may be there: elements that may be created, and whether it must be new."""

    elements: tuple[str, ...]
    may_create: tuple[bool, ...]
    must_be_new: bool


def parse_target(path: str) -> Target:
    """``?`` before an element lets it be created, ``!`` before the last one asks for it to be new."""
    names, create, new = [], [], False
    for element in filter(None, path.split("/")):
        new = element.startswith("!")
        flagged = element.startswith("?") or new
        names.append(element[1:] if flagged else element)
        create.append(flagged)
    return Target(tuple(names), tuple(create), new)


def parse_options(words: Iterable[str]) -> tuple[dict[str, str], list[str]]:
    r"""``key=value`` options, keys in lower case, and the other words; ``\=`` is an equals sign."""
    options, rest = {}, []
    for word in words:
        parts = re.split(r"(?<!\\)=", word, maxsplit=1)
        clean = [p.replace("\\=", "=") for p in parts]
        if len(clean) == 2:
            options[clean[0].lower()] = clean[1]
        else:
            rest.append(clean[0])
    return options, rest
