"""Source files as a table, and what changed of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.names import language

_SUFFIXES = "py ts tsx js jsx go rs java c h cpp hpp cc cxx cs php rb swift kt kts dart scala sc"
INCLUDE = tuple(f"**/*.{e}" for e in _SUFFIXES.split())
_FOLDERS = ".git .gradle .idea .mypy_cache .pytest_cache .venv Pods __pycache__ bin build coverage dist node_modules out site-packages target vendor venv"
EXCLUDE = (*(f"**/{f}/**" for f in _FOLDERS.split()), "**/*.bundle.js", "**/*.min.js")
MOST_BYTES = 1 << 20


def glob_regex(glob: str) -> str:
    """A glob whose * crosses folders; a leading ``**/`` also fits the top folder."""
    head, rest = ("(?:.*/)?", glob[3:]) if glob.startswith("**/") else ("", glob)
    return "^" + head + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in rest.replace("**", "*")) + "$"


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, most: int = MOST_BYTES, listed: DataFrame | None = None) -> DataFrame:
    """(path, content, language, size, content_hash, modified_at, read_error) of the files below root that include names and exclude doesn't.

    listed: (path) of the only files that count, such as those that git knows. What isn't UTF-8 has a null content and says so in read_error.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= most)
    base = re.sub(r"^file:(//)?", "", root.rstrip("/")) + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//)?", ""), "^" + re.escape(base), "")
    rows = found.select(path.alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"))
    rows = rows.where(F.col("path").rlike("|".join(map(glob_regex, include))) & ~F.col("path").rlike("|".join(map(glob_regex, exclude))))
    rows = rows if listed is None else rows.join(listed.select("path").distinct(), "path", "left_semi")
    text = F.col("content").cast("string")
    error = F.when(~F.is_valid_utf8(text), "not UTF-8")
    text = F.when(F.is_valid_utf8(text), text)
    return rows.select("path", text.alias("content"), language(F.col("path")).alias("language"), "size", F.sha2("content", 256).alias("content_hash"), "modified_at", error.alias("read_error"))


def changes(current: DataFrame, known: DataFrame) -> DataFrame:
    """(path, change): added, changed or removed, by path and hash of (path, content_hash)."""
    both = current.select("path", F.col("content_hash").alias("_new")).join(known.select("path", F.col("content_hash").alias("_old")), "path", "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")
