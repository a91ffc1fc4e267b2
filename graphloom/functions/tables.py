"""Table functions for SQL text: a changelog's entries and the expansions of a pattern, for use with LATERAL."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from graphloom.functions.registry import DATED, UNDATED
from graphloom.functions.text import expand_braces


def heading_of(line: str) -> tuple[str, str | None] | None:  # J12
    """(version, date) of a changelog heading, or None."""
    if not line.strip().startswith("#"):
        return None
    content = line.strip().lstrip("#").strip()
    for form in (*DATED, *UNDATED):
        if m := re.match(form, content, re.A):
            return m[1].lstrip("v"), m[2] if m.re.groups > 1 else None
    return None


class ChangelogEntries:  # J13
    """changelog_entries(text): entry_no, version, date, body. Entry 0 is what stands before the first heading; a null text has just that."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise TypeError("changelog_entries takes a text")
        return AnalyzeResult(StructType().add("entry_no", IntegerType()).add("version", StringType()).add("date", StringType()).add("body", StringType()))

    def eval(self, text: str | None):
        number, head, lines, begun = 0, (None, None), [], False
        for line in (text or "").split("\n"):
            if found := heading_of(line):
                if begun:
                    yield number, *head, "\n".join(lines).strip(" ")
                number, head, lines = number + 1, found, []
            else:
                lines.append(line)
            begun = True
        yield number, *head, "\n".join(lines).strip(" ")


class BraceExpansions:  # J2
    """brace_expansions(pattern, numbered): the patterns that braces stand for, left to right; with their numbers from 0 if numbered is true."""

    def __init__(self):
        self.numbered = None

    @staticmethod
    def analyze(pattern: AnalyzeArgument, numbered: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(numbered.value, bool):
            raise TypeError("brace_expansions needs true or false as its second argument")
        out = StructType().add("pattern", StringType())
        return AnalyzeResult(out.add("n", IntegerType()) if numbered.value else out)

    def eval(self, pattern: str | None, numbered: bool):
        for k, x in enumerate(expand_braces(pattern) if pattern is not None else ()):
            yield (x, k) if numbered else (x,)


def register_tables(spark: SparkSession) -> None:  # L9
    from pyspark.sql.functions import udtf

    spark.udtf.register("changelog_entries", udtf(ChangelogEntries, useArrow=True))
    spark.udtf.register("brace_expansions", udtf(BraceExpansions, useArrow=True))
