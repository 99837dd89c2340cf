"""Text lines of CSV files, read by header name, with the lines that fail set apart and the reason.

Blocks of lines with as many columns are parsed at once by Arrow's column reader and converted column by column. Where a
tenth of the blocks' lines may be bad, every block would fail; so tests over the whole block (quotes, number of columns,
look of a number) first mark suspects, which leave it. A block that still fails, as on a whole number that is too large,
is cut in two until the bad lines are alone. Suspects and lines that came to be alone are diagnosed one by one by the
strict rules. The strict rules decide: a line that they accept comes out as a row.

Reasons, the first that applies: `quoting` (a field begins with a quote and isn't closed on the line or is followed by
something other than a comma, or contains a quote without beginning with one), `column_count` (differs from the
header's), `missing_column` (the header lacks a wanted column), `invalid_value`; `no_header` where a file has none.

Defined cases: a null line, a blank one and one that starts with # are nothing; the header is the first other line of a
file by line number (the smaller identifier first among equals); a line without a number is data, never a header; a null
file name is a file of its own; repeated lines each come out; of repeated header names the first counts; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.common import join_nulls, maybe_broadcast

_FIELD = r'(?:"(?:[^"\r\n]|"")*"|[^",\r\n]*)'
WELL_QUOTED = rf"^{_FIELD}(?:,{_FIELD})*$"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^[nN][aA][nN]$"
DIGITS = r"^[0-9]+$"
#: Lines that a block holds at most.
BLOCK = 65_536

#: Columns of a catalogue file: whole (id), number (must be there) or maybe (may be empty or null).
STAR_COLUMNS = {"source_id": "whole", "ra": "number", "dec": "number", "parallax": "maybe", "parallax_error": "number", "phot_g_mean_mag": "maybe", "bp_rp": "maybe"}


def split_fields(line: str) -> list[str] | None:
    """The unquoted fields of a line; None if its quoting is broken."""
    out, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            end = at + 1
            while True:
                end = line.find('"', end)
                if end < 0:
                    return None
                if line[end + 1 : end + 2] != '"':
                    break
                end += 2
            out.append(line[at + 1 : end].replace('""', '"'))
            end += 1
            if end < len(line) and line[end] != ",":
                return None
        else:
            end = line.find(",", at)
            end = len(line) if end < 0 else end
            if '"' in line[at:end]:
                return None
            out.append(line[at:end])
        if end >= len(line):
            return out
        at = end + 1


def diagnose(line: str, header: list[str], columns: Mapping[str, str]) -> tuple[str | None, list]:
    """The reason why a line fails, or None, and its values."""
    none = [None] * len(columns)
    fields = split_fields(line)
    if fields is None:
        return "quoting", none
    if len(fields) != len(header):
        return "column_count", none
    values = []
    for name, kind in columns.items():
        if name not in header:
            return "missing_column", none
        v = fields[header.index(name)].strip()
        if kind == "maybe" and v in ("", "null"):
            values.append(None)
        elif kind == "whole":
            if not re.match(DIGITS, v) or len(v.lstrip("0")) > 19 or int(v.lstrip("0") or 0) >= 1 << 63:
                return "invalid_value", none
            values.append(int(v.lstrip("0") or 0))
        elif "\n" in v or not re.match(NUMBER, v):
            return "invalid_value", none
        else:
            values.append(float(v))
    return None, values


def _mask(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False)


def _well_formed(lines: pa.Array, width: int) -> np.ndarray:
    """Lines whose quoting and number of columns are right."""
    ok = _mask(pc.and_(pc.equal(pc.count_substring(lines, ","), width - 1), pc.invert(pc.match_substring_regex(lines, "[\r\n]"))))
    quoted = np.flatnonzero(_mask(pc.match_substring(lines, '"')))
    if len(quoted):  # commas inside quotes don't separate
        some = lines.take(pa.array(quoted))
        bare = pc.replace_substring_regex(some, '"(?:[^"]|"")*"', "")
        ok[quoted] = _mask(pc.and_(pc.match_substring_regex(some, WELL_QUOTED), pc.equal(pc.count_substring(bare, ","), width - 1)))
    return ok


def _read_fields(lines: pa.Array, width: int) -> list[pa.Array] | None:
    """The columns of a block of lines, or None if Arrow's reader fails."""
    text = "\n".join(lines.to_pylist()).encode()
    names = [str(i) for i in range(width)]
    try:
        t = csv.read_csv(
            io.BytesIO(text),
            read_options=csv.ReadOptions(column_names=names, block_size=len(text) + 2, use_threads=False),
            parse_options=csv.ParseOptions(ignore_empty_lines=False),
            convert_options=csv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    return [pa.concat_arrays(c.chunks) for c in t.columns] if t.num_rows == len(lines) else None


def _wanted(fields: list[pa.Array], place: np.ndarray, kinds: list[str]) -> tuple[list[pa.Array], np.ndarray]:
    """The texts of the wanted columns, by each line's own order of columns, and the lines where all look as they should."""
    n = len(place)
    out, ok, rows = [], np.ones(n, bool), np.arange(n)
    whole = None
    for k, kind in enumerate(kinds):
        at = np.unique(place[:, k])
        if len(at) == 1:
            v = fields[at[0]]
        else:
            whole = pa.concat_arrays(fields) if whole is None else whole
            v = whole.take(pa.array(place[:, k] * n + rows))
        v = pc.utf8_trim_whitespace(v)
        if kind == "maybe":
            v = pc.if_else(pc.is_in(v, pa.array(["", "null"])), None, v)
        ok &= _mask(pc.fill_null(pc.match_substring_regex(v, DIGITS if kind == "whole" else NUMBER), True))
        out.append(v)
    return out, ok


def _convert(texts: list[pa.Array], kinds: list[str]) -> list[pa.Array] | None:
    try:
        return [v.cast(pa.int64()) if kind == "whole" else pc.ascii_lower(pc.utf8_ltrim(v, "+")).cast(pa.float64()) for v, kind in zip(texts, kinds)]
    except pa.ArrowInvalid:
        return None


def _bisect(size: int, parse, alone: list[int]) -> Iterator[tuple[int, int, object]]:
    """(from, to, result) of the largest parts of a block that parse; places of lines that don't, alone, go to `alone`."""
    todo = [(0, size)] if size else []
    while todo:
        a, z = todo.pop()
        found = parse(a, z)
        if found is not None:
            yield a, z, found
        elif z - a == 1:
            alone.append(a)
        else:
            todo += [(a, (a + z) // 2), ((a + z) // 2, z)]


def _parse_block(lines: pa.Array, width: int, place: np.ndarray, kinds: list[str]) -> tuple[list[tuple[np.ndarray, list[pa.Array]]], np.ndarray]:
    """Parts (line numbers, values) of a block of lines with `width` columns, and the lines that the fast path can't take.

    place: each line's field numbers of the wanted columns.
    """
    formed = _well_formed(lines, width)
    rows = np.flatnonzero(formed)
    lines, place = lines.take(pa.array(rows)), place[rows]
    done, odd = [], [np.flatnonzero(~formed)]
    unread: list[int] = []
    for a, z, fields in _bisect(len(rows), lambda a, z: _read_fields(lines.slice(a, z - a), width), unread):
        texts, ok = _wanted(fields, place[a:z], kinds)
        odd.append(rows[a:z][~ok])
        good = np.flatnonzero(ok)
        if len(good) < len(ok):
            texts = [v.take(pa.array(good)) for v in texts]
        failed: list[int] = []
        for b, y, values in _bisect(len(good), lambda b, y: _convert([v.slice(b, y - b) for v in texts], kinds), failed):
            done.append((rows[a:z][good[b:y]], values))
        odd.append(rows[a:z][good[failed]])
    odd.append(rows[unread])
    return done, np.concatenate(odd)


def _parse(columns: Mapping[str, str]):
    kinds = list(columns.values())
    types = [pa.int64() if k == "whole" else pa.float64() for k in kinds]
    names = ["id", "file", *columns, "reason"]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            heads = b.column(3).dictionary_encode()
            code = heads.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            parts = [[x.strip() for x in split_fields(h) or h.split(",")] for h in heads.dictionary.to_pylist()]
            place = np.array([[p.index(c) if c in p else -1 for c in columns] for p in parts] or [[-1] * len(columns)], np.int64)
            widths = np.array([len(p) if (at >= 0).all() else 0 for p, at in zip(parts, place)] or [0])
            width = np.where(code < 0, 0, widths[code])
            strict = [np.flatnonzero(width == 0)]
            for w in np.unique(width[width > 0]):  # lines of files with as many columns share a block, whatever their order
                rows = np.flatnonzero(width == w)
                done, odd = _parse_block(b.column(2).take(pa.array(rows)), int(w), place[code[rows]], kinds)
                strict.append(rows[odd])
                for at, values in done:
                    take = pa.array(rows[at])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *values, pa.nulls(len(at), pa.string())], names=names)
            alone = np.concatenate(strict)
            if len(alone):
                at = pa.array(alone)
                found = [diagnose(t, parts[code[i]], columns) if code[i] >= 0 else ("no_header", [None] * len(columns)) for i, t in zip(alone, b.column(2).take(at).to_pylist())]
                values = [pa.array([f[1][k] for f in found], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *values, pa.array([f[0] for f in found], pa.string())], names=names)

    return run


def parse_lines(lines: DataFrame, ident: str = "line_id", file: str = "input_name", number: str = "line_no", text: str = "line", columns: Mapping[str, str] = STAR_COLUMNS) -> DataFrame:
    """Rows (ident, file, the wanted columns, reason): a valid line has its values and no reason, a reject only a reason."""
    rows = lines.select(F.col(ident).alias("__id"), F.col(file).alias("__file"), F.col(number).alias("__no"), F.col(text).alias("__text"))
    rows = rows.where(F.col("__text").isNotNull() & ~F.startswith("__text", F.lit("#")) & ~F.col("__text").rlike(r"^\s*$"))
    heads = rows.where(F.col("__no").isNotNull()).groupBy("__file").agg(F.min(F.struct("__no", "__id", F.col("__text").alias("__header"))).alias("__h"))
    heads = heads.select("__file", "__h.__header", F.col("__h.__no").alias("__hno"), F.col("__h.__id").alias("__hid"))
    data = join_nulls(rows, maybe_broadcast(heads), ["__file"], "left")
    is_head = (F.col("__no") == F.col("__hno")) & F.col("__id").eqNullSafe(F.col("__hid"))
    data = data.where(~F.coalesce(is_head, F.lit(False))).select("__id", "__file", "__text", "__header")
    kinds = ", ".join(f"`{c}` {'bigint' if k == 'whole' else 'double'}" for c, k in columns.items())
    schema = f"id {lines.schema[ident].dataType.simpleString()}, file string, {kinds}, reason string"
    found = data.mapInArrow(_parse(columns), schema)
    return found.select(F.col("id").alias(ident), F.col("file").alias(file), *columns, "reason")
