"""Source trees as rows: scanned in parallel, filtered by name and ignore rules, hashed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import repo_path
from ..streaming.watch import is_watched

# Folders that are ignored without being listed.
DEFAULT_IGNORED = ["dist", "build", "out", ".next", "coverage", ".cache"]


def ignore_patterns(gitignore: str = "") -> list[str]:
    """Regular expressions over repository paths for the lines of an ignore file, in order; a leading `!` takes paths back in."""
    out = []
    for line in [*DEFAULT_IGNORED, *gitignore.split("\n")]:
        line = line.strip()
        if not line or line[0] == "#":
            continue
        sign, line = ("!", line[1:]) if line[0] == "!" else ("", line)
        anchored, rule = "/" in line.rstrip("/"), line.strip("/")
        body = re.escape(rule).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        out.append(sign + ("^" if anchored else "(?:^|/)") + body + ("/" if line.endswith("/") else "(?:/|$)"))
    return out


def source_files(spark: SparkSession, root: str, gitignore: str = "") -> DataFrame:
    """(path, content, content_hash) of the TypeScript files under a folder."""
    folder = re.sub(r"^[a-z]+:/+", "/", root).rstrip("/")
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{ts,tsx}").select("value", F.col("_metadata.file_path").alias("file"))
    path = repo_path(F.regexp_replace(F.url_decode("file"), "^.*?" + re.escape(folder) + "/+", ""))
    return raw.select(path.alias("path"), F.col("value").alias("content"), F.sha2("value", 256).alias("content_hash")).where(is_watched(F.col("path"), ignore_patterns(gitignore)))
