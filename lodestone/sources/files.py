"""Folders of text files: scan with deny patterns, size and binary tests, change detection, pruning."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T


def folder(spark: SparkSession, path: str) -> DataFrame:
    """Path, modified, length, content of every file below a folder; a selection without content reads no file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"), "length", "content")


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression: * and ? also match a slash, [seq] and [!seq] are sets."""
    out, i = "", 0
    g = glob.lstrip("/")
    while i < len(g):
        c = g[i]
        end = g.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = g[i + 1 : end].replace("\\", "\\\\")
            out += f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^/?(?:{out})$"


def denied(path: Column, globs: Sequence[str]) -> Column:
    """Whether a path matches any of the patterns, with or without a leading slash."""
    return path.rlike("|".join(glob_pattern(g) for g in globs)) if globs else F.lit(False)


def is_binary(content: Column) -> Column:
    """A zero byte, or no valid UTF-8 and fewer than seven bytes of ten that belong to a text; empty content is text."""
    size = F.octet_length(content)
    odd = F.length(F.regexp_replace(F.decode(content, "ISO-8859-1"), r"[^\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    return F.coalesce((size > 0) & (F.contains(content, F.lit(b"\x00")) | ~F.is_valid_utf8(content.cast("string")) & (odd > 0.3 * size)), F.lit(False))


def file_format(path: Column) -> Column:
    """Markdown, html or text by the ending of the name."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("md", "markdown"), "markdown").when(ext.isin("html", "htm"), "html").otherwise("text")


def parsed(files: DataFrame) -> DataFrame:
    """Path, format, title, body of files (path, text), each by its format."""
    f = file_format(F.col("path"))
    title = F.when(f == "markdown", T.markdown_title("text")).when(f == "html", T.html_title("text")).otherwise(T.text_title("text"))
    body = F.when(f == "markdown", T.markdown_text("text")).when(f == "html", T.html_text("text")).otherwise(T.trimmed("text"))
    return files.select("path", f.alias("format"), title.alias("title"), body.alias("body"))


def scanned(files: DataFrame, deny: Sequence[str] = (), most_bytes: int = 512_000, extensions: Sequence[str] | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Files (path, modified, length, content) that are not denied, not too large, of the given endings
    or among the given paths, and no binaries. Tests on path and length come before content is looked at."""
    x = files.where(~denied(F.col("path"), deny) & (F.col("length") <= most_bytes))
    if extensions is not None:
        x = x.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(extensions)))
    if paths is not None:
        x = x.join(paths.select("path").distinct(), "path", "left_semi")
    return x.where(~is_binary(F.col("content")))


def changed(scan: DataFrame, index: DataFrame) -> DataFrame:
    """Files of a scan that the index (path, modified, length) lacks, or has with another time or length."""
    return scan.join(index.select("path", "modified", "length").distinct(), ["path", "modified", "length"], "left_anti")


def missing(index: DataFrame, scan: DataFrame) -> DataFrame:
    """Entries of the index whose file a completed scan did not see, to be pruned."""
    return index.join(scan.select("path").distinct(), "path", "left_anti")


def imports(files: DataFrame) -> DataFrame:
    """Path, module of every import line of a code text."""
    m = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?m)^[ \t]*(?:from|import)[ \t]+([\w.]+)"), F.lit(1))
    return files.select("path", F.explode(m).alias("module")).distinct()


def import_edges(files: DataFrame) -> DataFrame:
    """Path, target: files that a code text imports, by the module's dots as slashes, as a file or a package."""
    known = files.select(F.col("path").alias("target"), F.regexp_replace("path", r"(?:/__init__)?\.py$", "").alias("place")).distinct()
    return imports(files).select("path", F.regexp_replace("module", r"\.", "/").alias("place")).join(known, "place").select("path", "target").distinct()
