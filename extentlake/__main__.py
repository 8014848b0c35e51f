"""The command line: ``python -m extentlake <command> key=value ... [words]``.

``repo`` is the repository's folder (a URI); ``readonly=true`` forbids changes.  Words are paths or patterns; times are taken now.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .functions.patterns import parse_options, target_path
from .plans.commands import Commands
from .sources.repository import Repository, scan_files


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise ValueError(f"{text} is neither true nor false")
    return text.lower() == "true"


@dataclass(frozen=True)
class Command:
    """What a command runs, how many words it takes, and the type of each named parameter."""

    run: Callable[..., object]
    words: int = 0
    parameters: tuple[tuple[str, Callable[[str], object]], ...] = ()
    changes: bool = False


def _now() -> int:
    return int(time.time() * 1000)


COMMANDS = {
    "init": Command(lambda c: c.repository.init(_now()), changes=True),
    "list": Command(lambda c, path: c.list(path), 1),
    "find": Command(lambda c, glob, compat=False: c.find(glob, compat), 1, (("compat", _flag),)),
    "stats": Command(lambda c, path="/": c.stats(None if path == "/" else path), 0, (("path", str),)),
    "stat": Command(lambda c, path: c.stat(path), 1),
    "check": Command(lambda c, path: c.check(path), 1),
    "restore": Command(lambda c, path, to: c.export(path, to), 1, (("to", str),)),
    "del": Command(lambda c, path: c.delete(path, _now()), 1, changes=True),
    "mkdir": Command(lambda c, path: c.make_dir(path, _now()), 1, changes=True),
    "rmdir": Command(lambda c, path: c.remove(path, _now(), True), 1, changes=True),
    "unlink": Command(lambda c, path: c.remove(path, _now(), False), 1, changes=True),
    "rename": Command(lambda c, path, to, copy=False: c.rename(path, to, _now(), copy), 2, (("copy", _flag),), True),
    "reclaim": Command(lambda c, keepdays=0: c.reclaim(keepdays, _now()), 0, (("keepdays", int),), True),
    "blacklist": Command(lambda c, path, copies=False: c.blacklist(path, copies, _now()), 1, (("copies", _flag),), True),
    "blacklist-files": Command(lambda c, folder: c.blacklist_files(scan_files(c.repository.spark, folder).withColumnRenamed("size", "length")), 1, changes=True),
    "db-copy": Command(lambda c: c.repository.portable_copy(datetime.now())),
    "db-restore": Command(lambda c, folder: c.repository.restore_copy(folder), 1, changes=True),
    "db-compact": Command(lambda c, files=None: c.repository.compact(files), 0, (("files", int),), True),
    "db-migrate": Command(lambda c: c.repository.migrate(), changes=True),
    "target": Command(lambda c, path: c.target(target_path(path, datetime.now()), _now()), 1, changes=True),
    "reference": Command(lambda c, pattern: c.reference(pattern), 1),
}


def dispatch(spark: SparkSession, words: list[str]) -> object:
    """Run a command; what it returns."""
    options, rest = parse_options(words)
    if not rest or rest[0] not in COMMANDS:
        raise ValueError(f"the commands are {', '.join(COMMANDS)}")
    command, given = COMMANDS[rest[0]], rest[1:]
    types = dict(command.parameters)
    if len(given) != command.words:
        raise ValueError(f"{rest[0]} takes {command.words} words, not {len(given)}")
    if "repo" not in options:
        raise ValueError("repo=<folder> is missing")
    unknown = set(options) - set(types) - {"repo", "readonly"}
    if unknown:
        raise ValueError(f"{rest[0]} does not know {', '.join(sorted(unknown))}")
    read_only = _flag(options.get("readonly", "false"))
    if read_only and command.changes:
        raise PermissionError("the repository is open for reading only")
    named = {k: types[k](v) for k, v in options.items() if k in types}
    return command.run(Commands(Repository(spark, options["repo"], read_only)), *given, **named)


def main() -> None:
    found = dispatch(SparkSession.builder.getOrCreate(), sys.argv[1:])
    if isinstance(found, DataFrame):
        found.show(1000, truncate=False)
    elif found is not None:
        print(found)


if __name__ == "__main__":
    main()
