"""Functions of whole sheets, one or many at a time, without a pandas frame for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

Kernel = Callable[[dict[str, np.ndarray]], Iterable[tuple]]
#: Gets ids and first rows of sheets (and the end), and their columns; gives columns of the result.
Batches = Callable[[np.ndarray, np.ndarray, dict[str, pa.Array]], Iterator[list[pa.Array]]]
#: Rows that are worked on, and sent back, together.
ROWS = 65536
#: Solved sheets that a task keeps, and the most cells that one of them has.
KEPT, SMALL = 4096, 1024


def squeezed(lines: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's line with longer runs of empty lines than ``most`` cut to so many; and the original line of each new one that has cells."""
    own, where = np.unique(lines, return_inverse=True)
    new = np.cumsum(np.minimum(np.diff(own, prepend=-1), most + 1)) - 1
    back = np.full(int(new[-1]) + 1, -1, np.int64)
    back[new] = own
    return new[where], back


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its count, one after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _objects(column: pa.Array) -> np.ndarray:
    """An array of numpy's; equal texts are one object."""
    if not pa.types.is_string(column.type):
        return numbers(column)
    coded = column.dictionary_encode()
    texts = np.append(numbers(coded.dictionary).astype(object), None)
    return texts[pc.fill_null(coded.indices, -1).to_numpy()]


def _unpacked(table: pa.Table, packed: str) -> pa.Table:
    """A row for each value of the lists ``packed``, its place in the list as c; fields of structs become columns."""
    lists = table.column(packed).combine_chunks()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    at = pa.array(np.repeat(np.arange(len(lists)), counts))
    table = table.drop_columns([packed]).take(at).append_column("c", pa.array(ranges(np.zeros(len(lists), np.int64), counts), pa.int32()))
    values = lists.flatten()
    fields = zip([f.name for f in values.type], values.flatten()) if pa.types.is_struct(values.type) else [(packed, values)]
    for name, column in fields:
        table = table.append_column(name, column)
    return table


def per_batch(cells: DataFrame, columns: list[str], kernel: Batches, schema: str, dealt: bool = False) -> DataFrame:
    """Rows that ``kernel`` gives for some whole sheets at a time, each in the order of r and c.

    dealt: all of a sheet's rows are in one partition and stand together there, as those
    of order sheets do; otherwise they are dealt by sheet and sorted. A task holds
    ``ROWS`` rows or one sheet, whichever is more. Cells may come packed, without a column
    c: a row for each row of a sheet, with the values of its columns in a list, which
    takes a fraction of the time on the way to Python.
    """
    packed = next(f.name for f in cells.schema if isinstance(f.dataType, ArrayType)) if "c" in columns and "c" not in cells.columns else None
    sent = [*(c for c in columns if c == "r"), packed] if packed else columns
    cells = cells.select("sheet_id", *sent).where(F.col("sheet_id").isNotNull())
    places = [c for c in ("r", "c") if c in columns]
    types = to_arrow_schema(StructType.fromDDL(schema))

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if packed:
            table = _unpacked(table, packed)
            if not table.num_rows:
                return
        ids = numbers(table.column(0).combine_chunks())
        if len(places) == 2:  # of dealt rows only the sheets are known to stand together
            r, c = (numbers(table.column(n).combine_chunks()) for n in places)
            same = ids[1:] == ids[:-1]
            if (same & ((r[1:] < r[:-1]) | ((r[1:] == r[:-1]) & (c[1:] < c[:-1])))).any():
                table = table.take(np.lexsort((c, r, np.cumsum(np.append(True, ~same)))))
        cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
        for out in kernel(ids[cuts[:-1]], cuts, {n: table.column(n).combine_chunks() for n in columns}):
            whole = pa.RecordBatch.from_arrays([pa.array(x, f.type) if isinstance(x, np.ndarray) else x.cast(f.type) for x, f in zip(out, types)], schema=types)
            for at in range(0, whole.num_rows, ROWS):
                yield whole.slice(at, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = ROWS // 8 if packed else ROWS
        held, rows, most = [], 0, full
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < most:
                continue
            table = pa.Table.from_batches(held)
            ids = numbers(table.column(0).combine_chunks())
            ends = np.flatnonzero(ids[1:] != ids[:-1])
            if not len(ends):
                most = 2 * rows  # one sheet so far
                continue
            yield from done(table.slice(0, ends[-1] + 1))
            table = table.slice(ends[-1] + 1)
            held, rows, most = table.to_batches(), table.num_rows, max(full, 2 * table.num_rows)
        if held:
            yield from done(pa.Table.from_batches(held))

    if not dealt:
        cells = cells.repartition("sheet_id").sortWithinPartitions("sheet_id", *[c for c in sent if c in places])
    return cells.mapInArrow(run, schema)


def per_sheet(cells: DataFrame, columns: list[str], kernel: Kernel, schema: str, dealt: bool = False) -> DataFrame:
    """``sheet_id`` and the rows that ``kernel`` gives for each sheet from arrays of ``columns``, in the order of r and c.

    Small sheets with the same arrays have the same rows: a task keeps those it solved
    last, and solves each anew that it doesn't know.
    """
    types = to_arrow_schema(StructType.fromDDL(schema))
    state: dict = {}

    def fresh() -> None:
        state.update(known={}, rows=[], arrays=None)

    def solve(ids: np.ndarray, cuts: np.ndarray, given: dict[str, pa.Array]) -> Iterator[list[pa.Array]]:
        arrays = [_objects(x) for x in given.values()]
        if not state:
            fresh()
        spans = np.empty((len(ids), 2), np.int64)
        for i, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            part = [x[a:b] for x in arrays]
            key = tuple(tuple(x.tolist()) if x.dtype == object else x.tobytes() for x in part) if b - a <= SMALL else None
            span = state["known"].get(key) if key else None
            if span is None:
                new = list(kernel(dict(zip(given, part))))
                span = (len(state["rows"]), len(new))
                state["rows"] += new
                state["arrays"] = None
                if key:
                    state["known"][key] = span
            spans[i] = span
        if state["rows"]:
            if state["arrays"] is None:
                state["arrays"] = [pa.array(x, f.type) for x, f in zip(zip(*state["rows"]), list(types)[1:])]
            at = pa.array(ranges(spans[:, 0], spans[:, 1]))
            yield [np.repeat(ids, spans[:, 1]), *[x.take(at) for x in state["arrays"]]]
        if len(state["known"]) > KEPT or len(state["rows"]) > ROWS:
            fresh()

    return per_batch(cells, columns, solve, schema, dealt)
