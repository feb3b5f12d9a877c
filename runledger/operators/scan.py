"""Forbidden-term scan over text lines, with ordered exemptions, and its self-test."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import PROSE_SUFFIXES, UNSCANNED_ROOTS
from ..functions.text import code_part, contains_ignoring_case, excerpt, split_lines


@dataclass(frozen=True)
class Exemption:
    """Text the scan permits: a case-sensitive pattern, or a literal name.

    With ``path_prefix`` it holds only for paths that start with the prefix.
    """

    pattern: str
    literal: bool = False
    path_prefix: str | None = None


@dataclass(frozen=True)
class ScanRule:
    """A term that must not occur, and what is exempt, removed in the order given."""

    term: str
    exemptions: Sequence[Exemption] = ()

    def breaks(self, path: Column, line: Column) -> Column:
        """Whether the line still holds the term once comment and exemptions are gone."""
        left = code_part(line)
        for exemption in self.exemptions:
            if exemption.literal:
                cut = F.replace(left, F.lit(exemption.pattern), F.lit(""))
            else:
                cut = F.regexp_replace(left, exemption.pattern, "")
            if exemption.path_prefix is not None:
                cut = F.when(path.startswith(exemption.path_prefix), cut).otherwise(left)
            left = cut
        # The first test spares the replacements on lines without the term.
        return contains_ignoring_case(code_part(line), self.term) & contains_ignoring_case(
            left, self.term
        )


def in_scope(
    path: Column,
    skip_suffixes: Sequence[str] = PROSE_SUFFIXES,
    skip_roots: Sequence[str] = UNSCANNED_ROOTS,
) -> Column:
    """Whether a file, by its path below the scanned folder, is one the scan covers."""
    root = F.substring_index(path, "/", 1)
    prose = reduce(lambda a, b: a | b, [path.endswith(s) for s in skip_suffixes], F.lit(False))
    return ~prose & ~root.isin(*skip_roots)


def text_lines(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per line, numbered from 1, in the same task that read the text."""
    return split_lines(docs.select(F.col(path).alias("path"), F.col(text).alias("text")), "text")


def term_scan(docs: DataFrame, rule: ScanRule, path: str = "path", text: str = "text") -> DataFrame:
    """``(path, line_no, excerpt)`` of every line that breaks the rule.

    Narrow throughout: texts without the term are dropped before they are split.
    """
    suspects = docs.where(contains_ignoring_case(F.col(text), rule.term))
    return (
        text_lines(suspects, path, text)
        .where(rule.breaks(F.col("path"), F.col("line")))
        .select("path", "line_no", excerpt(F.col("line")).alias("excerpt"))
    )


def guard_selftest(rule: ScanRule, must_hit: DataFrame, must_miss: DataFrame) -> DataFrame:
    """Violations of the rule itself: bad lines it permits, good lines it rejects.

    Both inputs have ``path`` and ``line``. A rule that permits everything is a
    defect, so it needs lines it must hit.
    """
    breaks = rule.breaks(F.col("path"), F.col("line"))

    def report(df: DataFrame, verdict: str) -> DataFrame:
        return df.select(
            F.lit("guard").alias("gate"),
            F.col("path").alias("entity"),
            F.concat_ws(": ", F.lit(verdict), excerpt(F.col("line"))).alias("detail"),
        )

    hit = F.coalesce(breaks, F.lit(False))
    return report(must_hit.where(~hit), "permits").unionByName(
        report(must_miss.where(hit), "rejects")
    )
