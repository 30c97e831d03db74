"""Log lines with their order: from text files, or from any frame of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sawmill.config import Plugin


def read_lines(spark: SparkSession, paths: list[str] | str, include: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(source, block, pos, value): the lines of all files below ``paths``, in order by (block, pos) in a source.

    ``block`` is where the file's split starts, so one large file is read and parsed by many tasks.
    ``include`` is a glob that paths must match, ``exclude`` globs that they must not (``glob_regex``); other files are not opened.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(paths)
    path = F.col("_metadata.file_path")
    if include:
        lines = lines.where(path.rlike(glob_regex(include)))
    for pattern in exclude:
        lines = lines.where(~path.rlike(glob_regex(pattern)))
    return lines.select(path.alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")


def split_texts(df: DataFrame, source: str | Column, text: str | Column, block: str | Column | None = None) -> DataFrame:
    """The lines of texts, one text a source (or one block of a source)."""
    source, text = (F.col(c) if isinstance(c, str) else c for c in (source, text))
    block = F.lit(0) if block is None else F.col(block) if isinstance(block, str) else block
    lines = df.select(source.cast("string").alias("source"), block.cast("long").alias("block"), F.posexplode(F.split(text, "\n")).alias("pos", "value"))
    return lines.select("source", "block", F.col("pos").cast("long").alias("pos"), "value")


def glob_regex(pattern: str) -> str:
    """A regular expression, for a search in a path, that says what a glob takes: batch, stream and routing all use it.

    A pattern names the last parts of a path, so one without a slash is of file names. ``**/`` stands for any
    folders or none, ``*`` and ``?`` for characters of one part, ``[ab]`` and ``[!ab]`` for one character, ``{a,b}`` for either.
    """
    known = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}
    out, i, either = "", 0, 0
    while i < len(pattern):
        closing = pattern.find("]", i + 2) if pattern[i] == "[" else -1
        if closing > 0:
            token = pattern[i : closing + 1]
            inner = token[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^/" + inner[1:] if inner.startswith("!") else inner.replace("^", "\\^")) + "]"
        else:
            token = next((t for t in ("**/", "**") if pattern.startswith(t, i)), pattern[i])
            either += (token == "{") - (token == "}")
            out += "|" if token == "," and either > 0 else known.get(token, "\\" + token if token in r"\.+()[]^$|" else token)
        i += len(token)
    return f"(?:^|/)(?:{out})$"


def routed(lines: DataFrame, plugins: tuple[Plugin, ...]) -> list[tuple[Plugin, DataFrame]]:
    """Each plugin's lines: those of sources that its globs take and no earlier plugin has taken."""
    out, taken = [], F.lit(False)
    for plugin in plugins:
        takes = reduce(lambda a, p: a | F.col("source").rlike(glob_regex(p)), plugin.include, F.lit(False))
        leaves = reduce(lambda a, p: a | F.col("source").rlike(glob_regex(p)), plugin.exclude, F.lit(False))
        mine = takes & ~leaves
        out.append((plugin, lines.where(mine & ~taken)))
        taken = taken | mine
    return out


def reconcile(listed: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, change) between a listing and what is tracked (path, mtime): Added, Changed, Removed; unchanged files are left out."""
    both = listed.alias("l").join(tracked.alias("t"), "path", "full_outer")
    change = (
        F.when(F.col("t.mtime").isNull(), "Added").when(F.col("l.mtime").isNull(), "Removed").when(F.col("l.mtime") > F.col("t.mtime"), "Changed")
    )
    return both.select("path", change.alias("change")).where("change is not null")
