"""Text-shaping expressions: masking, lines, line numbers, block comments. All map-only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A source text is a sequence of these pieces: block comment, line comment, string, char literal,
# plain run, lone slash. Possessive quantifiers keep the matcher iterative, so that very long pieces
# cannot exhaust the stack.
_PIECE = (
    r"/\*(?s:.*?)(?:\*/|\z)"
    r"|//[^\n]*+"
    r'|"(?:[^"\\\n]++|\\[^\n]?+)*+"?+'
    r"|'(?:[^'\\\n]++|\\[^\n]?+)*+'?+"
    r"|[^/\"']++"
    r"|/"
)

#: Private marker put in front of matches while line numbers are taken.
MARK = "\x01"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code_pieces(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(_PIECE), F.lit(0))


def _blank_out(piece: Column) -> Column:
    return F.when(piece.contains("\n"), F.regexp_replace(piece, r"[^\n]", " ")).otherwise(
        F.repeat(F.lit(" "), F.length(piece))
    )


def _is_comment(piece: Column) -> Column:
    return piece.startswith("//") | piece.startswith("/*")


def without_comments(pieces) -> Column:
    """Comments blanked, literals kept; same length and same line breaks as the input."""
    return F.array_join(F.transform(_col(pieces), lambda p: F.when(_is_comment(p), _blank_out(p)).otherwise(p)), "")


def without_literals(pieces) -> Column:
    """Comments, string and char literals blanked; same length and same line breaks as the input."""
    return F.array_join(
        F.transform(
            _col(pieces),
            lambda p: F.when(_is_comment(p) | p.startswith('"') | p.startswith("'"), _blank_out(p)).otherwise(p),
        ),
        "",
    )


def mask_source(c, keep_literals: bool = False) -> Column:
    """Blank out comments (and literals). Text with no slash and no quote is returned as it is."""
    text = _col(c)
    pieces = code_pieces(text)
    masked = without_comments(pieces) if keep_literals else without_literals(pieces)
    interesting = text.contains("/") if keep_literals else text.rlike("[/\"']")
    return F.when(interesting, masked).otherwise(text)


def newline_count(c) -> Column:
    text = _col(c)
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def strip_trailing_newlines(c) -> Column:
    return F.rtrim(_col(c), F.lit("\n"))


def line_count(c, empty_is: int = 1) -> Column:
    """Lines by ``\\n``, trailing empty lines not counted. Newlines only: 0. Empty text: ``empty_is``."""
    text = _col(c)
    kept = strip_trailing_newlines(text)
    return F.when(text == "", empty_is).when(kept == "", 0).otherwise(newline_count(kept) + 1).cast("int")


def split_lines(c) -> Column:
    """All lines, trailing blanks kept."""
    return F.split(_col(c), "\n", -1)


# What ends a line beside the line feed, by the Unicode rules that Java's \\R follows.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]"


def split_any_lines(c) -> Column:
    """All lines by any line break, carriage return and line feed together being one; trailing blanks kept. Their numbers are not
    those of ``split_lines`` where a text holds form feeds, vertical tabs, next-line or separator characters."""
    return F.split(_col(c), LINE_BREAK, -1)


def count_occurrences(c, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    if not needle:
        return F.lit(0)
    text = _col(c)
    cut = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return F.coalesce((cut / F.lit(len(needle))).cast("int"), F.lit(0))


def line_hits(lines, pattern: str, probes=()) -> Column:
    """Numbers of the lines in which the pattern is found. With ``probes`` only lines whose lower-cased form holds one
    of these substrings are tried."""
    if probes:
        numbered = F.transform(F.transform(_col(lines), lambda line: F.lower(line)), lambda low, i: F.when(
            reduce(lambda a, b: a | b, [low.contains(p) for p in probes])
            & F.element_at(_col(lines), i + 1).rlike(pattern), i + 1))
    else:
        numbered = F.transform(_col(lines), lambda line, i: F.when(line.rlike(pattern), i + 1))
    return F.filter(numbered, lambda n: n.isNotNull())


def match_start_lines(c, pattern: str) -> Column:
    """Numbers of the lines on which a match in the whole text starts.

    A marker is put in front of every match; the marked lines are the answer. One regex pass, no offsets,
    no prefix rescans, and several matches on a line already count once. Markers that the text holds itself are left out.
    """
    marked = F.regexp_replace(F.replace(_col(c), F.lit(MARK), F.lit("")), f"(?:{pattern})", MARK + "$0")
    # as the element of an array, so that it is computed once, and only a text with a match is cut into lines
    with_match = F.filter(F.array(marked), lambda text: text.contains(MARK))
    lines = F.flatten(F.transform(with_match, lambda text: F.split(text, "\n", -1)))
    numbered = F.transform(lines, lambda line, i: F.when(line.contains(MARK), i + 1))
    return F.filter(numbered, lambda n: n.isNotNull())


# A run of lines inside a block comment: a line that opens one without closing it, the lines up to the
# closing one, and that closing line. A line holding both marks neither opens nor continues.
COMMENT_RUN = (
    r"(?m)^(?=[^\n]*/\*)(?![^\n]*\*/)[^\n]*+"
    r"(?:\n(?![^\n]*\*/)[^\n]*+)*+"
    r"(?:\n[^\n]*+)?+"
)
_RUN_OR_LINE = COMMENT_RUN + r"(?:\n|\z)|[^\n]*+(?:\n|\z)"


def comment_runs(c) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(COMMENT_RUN), F.lit(0))


def outside_comment_runs(c) -> Column:
    """The text with every comment run reduced to one empty line."""
    return F.regexp_replace(_col(c), COMMENT_RUN, "")


def classified_lines(c) -> Column:
    """array<struct<line, in_run>> of a text without trailing newlines, runs found in one pass."""
    pieces = F.regexp_extract_all(_col(c), F.lit(_RUN_OR_LINE), F.lit(0))
    # the last piece is the empty match at the end of the text
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(1)))
    return F.flatten(
        F.transform(
            pieces,
            lambda p: F.transform(
                F.split(F.regexp_replace(p, r"\n\z", ""), "\n", -1),
                lambda line: F.struct(line.alias("line"), F.regexp_like(p, F.lit(_OPENS_RUN)).alias("in_run")),
            ),
        )
    )


_OPENS_RUN = r"\A(?=[^\n]*/\*)(?![^\n]*\*/)"
