"""Delimited lines: sound rows typed, failing rows set apart with the reason.

Every cell is first kept as nullable text. Cast and constraint rules then fill an array of errors; a row is
sound when that array is empty. All of it is built-in expressions: a line is cut at tabs, and a fold over the
pieces joins those of one quoted cell again, in time linear in the line.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A number: optional sign, ASCII digits with an optional point, optional exponent, blanks around it.
NUMBER = r"^ *[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)? *$"


@dataclass(frozen=True)
class FileSpec:
    """Columns of one kind of file; ``numbers`` maps a numeric list column to its exclusive lower and inclusive upper bound."""

    columns: tuple[str, ...]
    id_column: str
    numbers: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)


#: The two kinds of delivered files (fixed values).
SPECS = {
    "dummy_constraints.tsv": FileSpec(("id", "speaker", "prompt", "gender", "duration"), "id", {"gender": (None, None), "duration": (0.0, None)}),
    "dummy_fraction_constraints.tsv": FileSpec(("id", "speaker", "prompt", "gender", "duration", "fraction"), "id", {"gender": (None, None), "duration": (0.0, None), "fraction": (0.0, 1.0)}),
}


def _fold(pieces: Column, keep: int) -> Column:
    """State after all tab-separated pieces: number of cells, spans of the first ``keep`` cells, bad quoting, open cell."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("open"), F.lit(False).alias("bad"), F.array().cast("array<struct<s:int,len:int>>").alias("spans"))

    def step(s: Column, piece: Column) -> Column:
        at = s["at"] + 1
        inside = s["open"] > 0
        quoted = inside | piece.startswith('"')
        rest = F.replace(F.when(inside, piece).otherwise(F.substring(piece, 2, 2_147_483_647)), F.lit('""'), F.lit(""))
        place = F.instr(rest, '"')
        closed = quoted & (place == F.length(rest)) & (place > 0)
        wrong = F.when(quoted, (place > 0) & ~closed).otherwise(F.instr(piece, '"') > 0)
        ends = ~quoted | (place > 0)
        begin = F.when(inside, s["open"]).otherwise(at)
        span = F.struct(begin.cast("int").alias("s"), (at - begin + 1).cast("int").alias("len"))
        spans = F.when(ends & (F.size(s["spans"]) < keep), F.concat(s["spans"], F.array(span))).otherwise(s["spans"])
        return F.struct(at.cast("int").alias("at"), (s["n"] + ends.cast("int")).cast("int").alias("n"), F.when(ends, 0).otherwise(begin).cast("int").alias("open"), (s["bad"] | wrong).alias("bad"), spans.alias("spans"))

    return F.aggregate(pieces, start, step)


def _cells(line: str, keep: int) -> Column:
    """``struct(cells array<string>, n int, bad boolean)`` of a line."""
    pieces = F.split(F.col(line), "\t", -1)
    state = _fold(pieces, keep)

    def cell(span: Column) -> Column:
        text = F.array_join(F.slice(pieces, span["s"], span["len"]), "\t")
        inner = F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))
        return F.when(text.startswith('"'), inner).otherwise(text)

    plain = F.struct(F.slice(pieces, 1, keep).alias("cells"), F.size(pieces).alias("n"), F.lit(False).alias("bad"))
    folded = F.transform(F.array(state), lambda s: F.struct(F.transform(s["spans"], cell).alias("cells"), (s["n"] + (s["open"] > 0).cast("int")).alias("n"), (s["bad"] | (s["open"] > 0)).alias("bad")))[0]
    return F.when(F.instr(F.col(line), '"') > 0, folded).otherwise(plain)


def _number_errors(name: str, low: float | None, high: float | None) -> Column:
    parts = F.split(F.col(f"_cell.{name}"), ",", -1)
    numbers = F.transform(parts, lambda x: F.trim(x).try_cast("double"))
    well = F.forall(parts, lambda x: x.rlike(NUMBER))
    checks = [F.when(~well | F.col(f"_cell.{name}").isNull(), F.struct(F.lit("value").alias("reason"), F.lit(f"{name}: not a list of numbers").alias("detail")))]
    bounds = F.lit(True)
    if low is not None:
        bounds = bounds & F.forall(numbers, lambda x: F.coalesce(x > low, F.lit(False)))
    if high is not None:
        bounds = bounds & F.forall(numbers, lambda x: F.coalesce(x <= high, F.lit(False)))
    if low is not None or high is not None:
        checks.append(F.when(well & ~bounds, F.struct(F.lit("value").alias("reason"), F.lit(f"{name}: out of bounds").alias("detail"))))
    return F.array(*checks)


def _judged(lines: DataFrame, specs: dict[str, FileSpec]) -> DataFrame:
    """:func:`parse_lines` with a row number ``_row``. A filter that names it is not merged into the rules, which would then run once for every place that reads them."""
    return parse_lines(lines, specs).withColumns({"errors": F.col("errors"), "_row": F.monotonically_increasing_id()})


def parse_lines(lines: DataFrame, specs: dict[str, FileSpec] = SPECS) -> DataFrame:
    """All columns of ``lines`` with ``cells map<string,string>`` and ``errors array<struct<reason,detail>>``.

    Reasons, in this order: ``unknown_file`` (no such ``file_name``, or null), ``quoting``, ``column_count``,
    ``value``. Blanks, tabs and line breaks at the very end of a line belong to no cell. A null line counts as
    an empty one and fails by its column count. Cells of a line with bad quoting or a wrong number of
    columns are not judged further. Other columns of the input are kept, but for ``cells`` and ``errors``,
    which are replaced; names beginning with ``_`` are used inside.
    """
    keep = max((len(s.columns) for s in specs.values()), default=1)
    rows = lines.withColumn("_line", F.rtrim(F.coalesce("raw_line", F.lit("")), F.lit(" \t\r\n"))).withColumn("_parsed", _cells("_line", keep))
    none = F.array().cast("array<struct<reason:string,detail:string>>")
    names = sorted({c for s in specs.values() for c in s.columns})
    picks, errors, widths = [], none, F.lit(None).cast("int")
    for c in names:
        pick = F.lit(None).cast("string")
        for file, s in specs.items():
            if c in s.columns:
                pick = F.when(F.col("file_name") == file, F.get(F.col("_parsed.cells"), F.lit(s.columns.index(c)))).otherwise(pick)
        picks.append(pick.alias(c))
    for file, s in specs.items():
        widths = F.when(F.col("file_name") == file, len(s.columns)).otherwise(widths)
        rules = [F.array(F.when(F.trim(F.coalesce(F.col(f"_cell.{s.id_column}"), F.lit("")), F.lit(" \t\r\n")) == "", F.struct(F.lit("value").alias("reason"), F.lit(f"{s.id_column}: blank").alias("detail"))))]
        rules += [_number_errors(n, *b) for n, b in s.numbers.items()]
        errors = F.when(F.col("file_name") == file, F.filter(F.concat(*rules), lambda e: e.isNotNull())).otherwise(errors)

    def one(reason: str, detail: Column) -> Column:
        return F.array(F.struct(F.lit(reason).alias("reason"), detail.alias("detail")))

    rows = rows.withColumn("_cell", F.struct(*picks)).withColumn("_width", widths)
    errors = (
        F.when(F.col("_width").isNull(), one("unknown_file", F.coalesce("file_name", F.lit("null"))))
        .when(F.col("_parsed.bad"), one("quoting", F.lit("unbalanced or misplaced quote")))
        .when(F.col("_parsed.n") != F.col("_width"), one("column_count", F.concat(F.col("_parsed.n").cast("string"), F.lit(" instead of "), F.col("_width").cast("string"))))
        .otherwise(errors)
    )
    return rows.withColumn("errors", errors).drop("_line", "_parsed", "_width").withColumnRenamed("_cell", "cells")


def failed_lines(lines: DataFrame, specs: dict[str, FileSpec] = SPECS) -> DataFrame:
    """``line_id, file_name, reason, details, raw_line``: one row per failing line with its first reason."""
    bad = _judged(lines.select("line_id", "file_name", "raw_line"), specs).where((F.size("errors") > 0) & (F.col("_row") >= 0))
    return bad.select("line_id", "file_name", F.col("errors")[0]["reason"].alias("reason"), F.transform("errors", lambda e: e["detail"]).alias("details"), "raw_line")


def load_lines(lines: DataFrame, file_name: str, specs: dict[str, FileSpec] = SPECS) -> DataFrame:
    """The sound lines of one kind of file as typed rows, with their ``line_id``.

    The id is trimmed; other text columns become the list of their trimmed non-empty parts (an empty cell gives an empty
    list); numeric columns become ``array<double>``. A line sent twice gives two rows, told apart by ``line_id``.
    """
    spec = specs[file_name]
    good = _judged(lines.select("line_id", "file_name", "raw_line").where(F.col("file_name") == file_name), specs).where((F.size("errors") == 0) & (F.col("_row") >= 0))
    out = [F.col("line_id")]
    for c in spec.columns:
        cell = F.col(f"cells.{c}")
        if c == spec.id_column:
            out.append(F.trim(cell, F.lit(" \t\r\n")).alias(c))
        elif c in spec.numbers:
            out.append(F.transform(F.split(cell, ",", -1), lambda x: F.trim(x).try_cast("double")).alias(c))
        else:
            out.append(F.filter(F.transform(F.split(cell, ",", -1), lambda x: F.trim(x, F.lit(" \t\r\n"))), lambda x: x != "").alias(c))
    return good.select(*out)
