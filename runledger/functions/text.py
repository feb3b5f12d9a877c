"""Text expressions: lines, tails, comments, excerpts, file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .fixed import COMMENT_MARK, EXCERPT_CHARS, NOISE_LINE_PATTERNS

# Every separator a universal line splitter knows, the two-character one first.
ANY_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
NEWLINE = "\n"


def split_lines(
    texts: DataFrame, text: str, line_break: str = ANY_BREAK, last: int | None = None
) -> DataFrame:
    """One row ``(line_no, line)`` per line of a text column, numbered from 1, others kept.

    A trailing break adds no empty line. With ``last`` only that many from the
    end. The text is split in a projection of its own and the generator takes an
    expression over it: given a bare column, Catalyst would infer a non-empty
    filter and split every text again to evaluate it.
    """
    kept = [c for c in texts.columns if c != text]
    split = texts.select(*kept, F.split(text, line_break).alias("__split"))
    n_lines = F.size("__split") - (F.element_at("__split", -1) == "").cast("int")
    skipped = F.greatest(n_lines - last, F.lit(0)) if last is not None else F.lit(0)
    counted = split.select(
        *kept, "__split", n_lines.alias("__n"), skipped.alias("__skipped")
    )
    lines = F.slice("__split", F.col("__skipped") + 1, F.col("__n") - F.col("__skipped"))
    return counted.select(
        *kept, "__skipped", F.posexplode(lines).alias("__pos", "line")
    ).select(
        *kept, (F.col("__skipped") + F.col("__pos") + 1).cast("bigint").alias("line_no"), "line"
    )


def code_part(line: Column) -> Column:
    """What stands before the first comment mark."""
    return F.substring_index(line, COMMENT_MARK, 1)


def excerpt(line: Column, chars: int = EXCERPT_CHARS) -> Column:
    """``line`` without outer white space, cut for display."""
    return F.substring(
        F.regexp_replace(line, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", ""), 1, chars
    )


def contains_ignoring_case(text: Column, term: str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(term)))


def is_noise(line: Column) -> Column:
    """True for the lines of an import-error listing that carry no error."""
    return reduce(lambda a, b: a | b, [line.rlike(p) for p in NOISE_LINE_PATTERNS])


def file_stem(path: Column) -> Column:
    """File name without folders and without its last suffix."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, "\\.[^.]*$", "")
