"""Scanners: what reads a text and gives typed rows. A scanner is a table function that is registered by name, so that a query names the
scanner it wants and another one takes its place without a change of the query."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

#: The columns of the scanners that come with the library.
ITEMS = "ord int, line int, item string, size int"


class Lines:
    """Each line that has more than blanks, stripped, with its length."""

    def eval(self, text: str):
        found = ((n, line.strip(" \t\r\v\f")) for n, line in enumerate((text or "").split("\n"), 1))
        for i, (n, line) in enumerate((n, line) for n, line in found if line):
            yield i, n, line, len(line)


class Numbers:
    """Each run of ASCII digits, with the line it stands in."""

    def eval(self, text: str):
        found = ((n, m[0]) for n, line in enumerate((text or "").split("\n"), 1) for m in re.finditer("[0-9]+", line))
        for i, (n, digits) in enumerate(found):
            yield i, n, digits, len(digits)


def register(spark: SparkSession, name: str, handler: type, returns: str) -> str:
    """Register a scanner: a class whose ``eval(text)`` yields rows of the columns ``returns``; null texts reach it as None. The name comes back."""
    if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name!r} is no name for a scanner")
    spark.udtf.register(name, udtf(handler, returnType=returns))
    return name


def scan(files: DataFrame, scanner: str, text: str = "content") -> DataFrame:
    """``files`` without their text, with the rows that the registered scanner gives for it, where the files lie; a file without rows is absent."""
    rest = "".join(f"files.`{c}`, " for c in files.columns if c != text)
    return files.sparkSession.sql(f"SELECT {rest}found.* FROM {{files}} AS files, LATERAL {scanner}(files.`{text}`) AS found", files=files)
