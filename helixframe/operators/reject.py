"""Rows that fail to parse: a finite-state tokenizer over raw records, typed rows and reasons.

The tokenizer is a five-state automaton over the bytes of many records at once. The byte stream is
cut into chunks of equal length; every chunk is run from all states at the same time (one table
look-up per byte position, for all chunks together), which gives a state-to-state map per chunk. The
maps are composed by a parallel prefix scan, so each chunk learns the state it starts in, and a second
run writes the state of every byte. Records longer than a chunk cost nothing special.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from helixframe.sources.formats import gaf_columns

# Byte classes and states.
TAB, QUOTE, OTHER, END = range(4)
START, PLAIN, QUOTED, CLOSED, BROKEN = range(5)
#: NEXT[class, state]
NEXT = np.array(
    [
        [START, START, QUOTED, START, BROKEN],
        [QUOTED, PLAIN, CLOSED, QUOTED, BROKEN],
        [PLAIN, PLAIN, QUOTED, BROKEN, BROKEN],
        [START, START, START, START, START],
    ],
    dtype=np.uint8,
)
#: Bytes of records that are tokenized together; a longer record goes alone.
STREAM = 4_000_000
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[9], _CLASS[34] = TAB, QUOTE


def byte_states(cls: np.ndarray, chunk: int = 256) -> np.ndarray:
    """State before each byte of a class stream that starts in START; computed chunk-wise as described above."""
    n = len(cls)
    if not n:
        return np.zeros(0, np.uint8)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, END, dtype=np.uint8)
    grid[:n] = cls
    grid = grid.reshape(rows, chunk)
    maps = np.tile(np.arange(5, dtype=np.uint8), (rows, 1))
    for j in range(chunk):
        maps = NEXT[grid[:, j, None], maps]
    step = 1
    while step < rows:  # inclusive prefix composition of the maps
        head = maps[:-step]
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], head, 1)])
        step *= 2
    state = np.zeros(rows, dtype=np.uint8)
    state[1:] = maps[:-1, START]
    out = np.empty((rows, chunk), dtype=np.uint8)
    for j in range(chunk):
        out[:, j] = state
        state = NEXT[grid[:, j], state]
    return out.reshape(-1)[:n]


def tokenize(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Fields of each line (list of strings, quotes taken off) and the byte offset of a quoting error, else -1."""
    return tokenize_at(lines)[:2]


def tokenize_at(lines: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The same, and the bytes after each field (of its tab, or the line's end)."""
    lines = lines.cast(pa.large_binary())
    n = len(lines)
    raw = [b"" if x is None else x for x in lines.to_pylist()] if lines.null_count else None
    if raw is not None:
        lines = pa.array(raw, pa.large_binary())
    off = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset : lines.offset + n + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]] if n else np.zeros(0, np.uint8)
    off = off - off[0] if n else np.zeros(1, np.int64)
    lens = np.diff(off)
    # A class stream with one END after each line.
    ends = off[1:] + np.arange(n)
    total = int(off[-1]) + n
    is_end = np.zeros(total, dtype=bool)
    is_end[ends] = True
    byte = np.zeros(total, dtype=np.uint8)
    byte[~is_end] = data
    cls = _CLASS[byte]
    cls[is_end] = END
    st = byte_states(cls)
    begins = ends - lens
    # The first byte that breaks a line, or its end inside quotes.
    error = np.full(n, -1, dtype=np.int64)
    breaks = np.flatnonzero((cls == OTHER) & (st == CLOSED))
    line_of = np.searchsorted(ends, breaks)
    first = np.unique(line_of, return_index=True)
    error[first[0]] = breaks[first[1]] - begins[first[0]]
    open_end = (st[ends] == QUOTED) & (error < 0)
    error[open_end] = lens[open_end]
    sep = is_end | ((cls == TAB) & (st != QUOTED) & (st != BROKEN))
    keep = ~(sep | ((cls == QUOTE) & ((st == START) | (st == QUOTED))))
    at = np.flatnonzero(sep)
    kept = np.concatenate([[0], np.cumsum(keep)])
    field_off = np.concatenate([[0], kept[at]]).astype(np.int64)
    fields = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(field_off), pa.py_buffer(byte[keep].tobytes()))
    line_off = np.concatenate([[0], np.searchsorted(at, ends) + 1]).astype(np.int32)
    field_end = at - np.repeat(begins, np.diff(line_off))
    return pa.ListArray.from_arrays(pa.array(line_off), fields.cast(pa.string())), error, pa.ListArray.from_arrays(pa.array(line_off), pa.array(field_end, pa.int64()))


def _tokenizer(passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            line = b.column("__hf_line")
            part = np.cumsum(pc.fill_null(pc.binary_length(line), 0).to_numpy(zero_copy_only=False)) // STREAM
            cuts = np.flatnonzero(np.diff(part)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                fields, error, end = tokenize_at(line.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(lo, hi - lo) for c in passed], fields, pa.array(error), end], names=[*passed, "fields", "quote_error_at", "field_end"])

    return run


def tokenize_lines(df: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``fields``, ``quote_error_at`` (-1: none) and ``field_end`` (bytes) for each line that is a record.

    One trailing carriage return is not part of a line. NULL and empty lines, lines that begin with
    ``#`` or ``!``, and ``track`` / ``browser`` lines are no records and are left out in the JVM.
    """
    text = F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"\r\z", "")
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    names = [f"k{i}" for i in range(len(keep))]
    x = df.select(*kept, text.alias("__hf_line")).where((F.col("__hf_line") != "") & ~F.col("__hf_line").rlike(r"\A(?:[#!]|(?:track|browser)\s)"))
    schema = ", ".join([*(f"{n} {x.schema[n].dataType.simpleString()}" for n in names), "fields array<string>, quote_error_at bigint, field_end array<bigint>"])
    y = x.mapInArrow(_tokenizer(names), schema)
    return y.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "fields", "quote_error_at", "field_end")


def _digits(c: Column) -> Column:
    return c.rlike(r"\A[0-9]+\z") & c.try_cast("bigint").isNotNull()


def bad_field(fmt: Column, fields: Column) -> Column:
    """Number (from 1) of the first field whose value is bad, else NULL; of borders in the wrong order the third."""
    n, f = F.size(fields), lambda i: F.get(fields, F.lit(i - 1))
    ordered = f(2).try_cast("bigint") <= f(3).try_cast("bigint")
    borders = F.when(~_digits(f(2)), 2).when(~_digits(f(3)) | ~ordered, 3)
    number = f(8).rlike(r"\A[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z")
    return (
        F.when(fmt == "bed", borders)
        .when(fmt == "narrowpeak", F.coalesce(borders, F.when((n >= 10) & ~number, 8)))
        .when(fmt == "gaf", F.when(~f(5).rlike(r"\AGO:[0-9]{7}\z"), 5))
    )


def reject_reason(fmt: Column, fields: Column, quote_error_at: Column) -> Column:
    """The first reason that applies (quoting, columns, value), else NULL; an unknown format has none."""
    n = F.size(fields)
    off = (fmt == "bed") & (n < 3) | (fmt == "narrowpeak") & (n != 3) & (n < 10) | (fmt == "gaf") & (n != 17)
    return F.when(quote_error_at >= 0, "quoting").when(off, "columns").when(bad_field(fmt, fields).isNotNull(), "value")


def parse_lines(df: DataFrame, *, line: str = "line", fmt: str = "fmt", keep: list[str] = ("line_id",)) -> DataFrame:
    """Every record with its fields, ``reason`` (NULL: readable) and ``error_offset``.

    ``error_offset`` is the byte at which the quoting broke, the line's end for ``columns``, the first
    byte of the first bad field for ``value``, NULL for readable records. The rows keep the columns
    ``keep`` and ``fmt``; nothing is dropped but lines that are no records.
    """
    t = tokenize_lines(df, line, [*dict.fromkeys([*keep, fmt])])
    reason = reject_reason(F.col(fmt), F.col("fields"), F.col("quote_error_at"))
    bad = bad_field(F.col(fmt), F.col("fields"))
    at = F.when(F.col("reason") == "quoting", F.col("quote_error_at")).when(F.col("reason") == "columns", F.element_at("field_end", -1)).when(F.col("reason") == "value", F.get("field_end", bad - 2) + 1)
    return t.withColumn("reason", reason).withColumn("error_offset", at).drop("quote_error_at", "field_end")


def load_intervals(parsed: DataFrame, fmt_col: str = "fmt", keep: list[str] = ("line_id",)) -> DataFrame:
    """The readable bed and narrowPeak records as typed rows.

    A name ``.`` is NULL; scores that are no integers are NULL; strand + is true, - false, else NULL;
    narrowPeak columns are NULL for bed and for three-column records, and negative p and q are NULL.
    """
    f = lambda i: F.get("fields", F.lit(i - 1))
    np_ = (F.col(fmt_col) == "narrowpeak") & (F.size("fields") >= 10)
    num = lambda i: F.when(np_, f(i).try_cast("double"))
    return parsed.where(F.col("reason").isNull() & F.col(fmt_col).isin("bed", "narrowpeak")).select(
        *keep, fmt_col, f(1).alias("chrom"), f(2).cast("bigint").alias("chrom_start"), f(3).cast("bigint").alias("chrom_end"),
        F.when(f(4) != ".", f(4)).alias("name"), f(5).try_cast("int").alias("score"),
        F.when(f(6) == "+", True).when(f(6) == "-", False).alias("strand"),
        num(7).alias("signal"), F.when(num(8) >= 0, num(8)).alias("pvalue"), F.when(num(9) >= 0, num(9)).alias("qvalue"),
        F.when(np_, f(10).try_cast("int")).alias("peak"))


def load_annotations(parsed: DataFrame, fmt_col: str = "fmt", keep: list[str] = ("line_id",)) -> DataFrame:
    """The readable GAF records as typed rows: the 17 columns and ``go_number``.

    Empty fields are NULL; columns of several values are arrays, split at ``|`` without empty values.
    """
    return parsed.where(F.col("reason").isNull() & (F.col(fmt_col) == "gaf")).select(*keep, fmt_col, *gaf_columns("fields"))


def load_files(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Lines of raw files (gzip is read by its suffix) parsed by :func:`parse_lines`, with the file's path."""
    x = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file_name"), F.lit(fmt).alias("fmt"), F.col("value").alias("line"))
    return parse_lines(x, keep=["file_name", "fmt"])
