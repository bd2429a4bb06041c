"""Oversized texts and tables in pieces under a limit, cut at natural boundaries, with overlap.

One regular expression consumes the text: its alternatives, strongest boundary first, each
take as much as fits; the last takes single characters. Every quantifier is bounded and a
boundary is looked for behind the characters taken, so no piece exceeds the limit whatever
stands there. All counts are of code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may stand before a cut of a text, strongest first (paragraph, sentence, line, clause, word).
TEXT_BOUNDARIES = (
    r"(?<=\n)(?<=\n[ \t]{0,250}\n)",
    r"(?:(?<=[ \xa0\n])(?<=[.!?…][\"'”’»)\]]{0,9}[ \xa0\n])|(?<=[。！？।॥」』”’）])(?<=[。！？।॥][」』”’）]{0,9})(?![」』”’）]))",
    r"(?<=\n)",
    r"(?<=[;:,][ \n]|[、，；：])",
    r"(?<=[ \xa0\u3000\t])",
)
# The same for a table written as lines of cells.
TABLE_BOUNDARIES = (r"(?<=\n)", r"(?<=\u001f)", r"(?<=[ \xa0])")
CELL, ROW = "\u001f", "\n"


def segment_pattern(size: int, boundaries: tuple[str, ...]) -> str:
    """A pattern whose matches, one after the other, cover any text in segments of at most `size` code points.

    Cuts before half of `size` are not sought, so a segment followed by another is at
    least that long; a cut never parts a base character from its combining marks unless
    more than half of `size` of them stand in a row.
    """
    most = f".{{{max(1, size // 2)},{size}}}"
    return f"(?s:.{{1,{size}}}\\z|" + "|".join(most + b for b in boundaries) + f"|{most}(?!\\p{{M}})|.{{1,{size}}})"


def _let(value: Column, use: object) -> Column:
    """`use` of `value`, which is evaluated once however often that names it."""
    return F.get(F.transform(F.array(value), use), 0)


def pieces(text: Column, max_chars: int, overlap: int, boundaries: tuple[str, ...] = TEXT_BOUNDARIES) -> Column:
    """Array of texts: the pieces of `text` in order.

    A text of at most `max_chars` is one piece, an empty one too; NULL stays NULL. Every
    later piece begins with the last `overlap` code points of the one before.
    """
    if not 0 <= overlap < max_chars // 3:
        raise ValueError("the overlap must be less than a third of the limit")
    segments = F.regexp_extract_all(text, F.lit(f"({segment_pattern(max_chars - overlap, boundaries)})"), F.lit(1))
    before = lambda all_of, i: F.right(F.get(all_of, i - 1), F.lit(overlap))
    joined = _let(segments, lambda all_of: F.transform(all_of, lambda s, i: F.when(i > 0, F.concat(before(all_of, i), s)).otherwise(s)))
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(joined)


def _running(lengths: Column) -> Column:
    """The sum of all before each of `lengths`, by sums of blocks, so that long arrays take no quadratic time."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, b: a + b)
    block = F.ceil(F.sqrt(F.size(lengths))).cast("int")
    in_blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: total(F.slice(lengths, b * block + 1, block)))
    full = lambda i: F.floor(i / block).cast("int")
    return _let(in_blocks, lambda sums: F.transform(lengths, lambda _, i: total(F.slice(sums, F.lit(1), full(i))) + total(F.slice(lengths, full(i) * block + 1, i - full(i) * block))))


def placed(cut: DataFrame, array_col: str, overlap: int) -> DataFrame:
    """One row per piece of `array_col`: piece_no, start (0-based place in the text), chars, piece."""
    added = F.transform(array_col, lambda p, i: F.length(p) - F.when(i > 0, F.lit(overlap)).otherwise(0))
    starts = F.when(F.size(array_col) > 1, _let(added, _running)).otherwise(F.array(F.lit(0)))
    each = _let(starts, lambda at: F.transform(array_col, lambda p, i: F.struct(i.alias("piece_no"), (F.get(at, i) - F.when(i > 0, F.lit(overlap)).otherwise(0)).alias("start"), F.length(p).alias("chars"), p.alias("piece"))))
    kept = [c for c in cut.columns if c != array_col]
    return cut.select(*kept, F.explode(each).alias("_q")).select(*kept, "_q.*")


def table_text(rows: Column) -> Column:
    """The cells of a table as lines; NULL cells and rows are empty."""
    line = lambda r: F.array_join(F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit(""))), CELL)
    return F.array_join(F.transform(rows, line), ROW)


def cell_chars(rows: Column) -> Column:
    """Characters of all cells of a table."""
    of_row = lambda r: F.aggregate(F.coalesce(r, F.array().cast("array<string>")), F.lit(0), lambda n, c: n + F.coalesce(F.length(c), F.lit(0)))
    return F.aggregate(rows, F.lit(0), lambda n, r: n + of_row(r))


def split_texts(df: DataFrame, id_col: str, text_col: str, max_chars: int, overlap: int) -> DataFrame:
    """Pieces of every text: id_col, n_pieces, piece_no, start, chars, piece. NULL texts have none."""
    cut = df.select(id_col, pieces(F.col(text_col), max_chars, overlap).alias("_a")).where("_a is not null").withColumn("n_pieces", F.size("_a"))
    return placed(cut, "_a", overlap)


def split_tables(df: DataFrame, id_col: str, rows_col: str, max_chars: int, overlap: int) -> DataFrame:
    """The same of tables, whose text is their lines of cells (cells parted by U+001F).

    A table whose cells have at most `max_chars` characters together stays whole, whatever
    its separators add; the pieces of a larger one are within the limit with them.
    """
    text = table_text(F.col(rows_col))
    whole = cell_chars(F.col(rows_col)) <= max_chars
    cut = df.where(F.col(rows_col).isNotNull()).select(id_col, F.when(whole, F.array(text)).otherwise(pieces(text, max_chars, overlap, TABLE_BOUNDARIES)).alias("_a")).withColumn("n_pieces", F.size("_a"))
    return placed(cut, "_a", overlap)
