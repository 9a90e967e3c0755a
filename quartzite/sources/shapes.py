"""Texts that differ only in numbered names have the same tree: the first two of a shape are parsed, the others take its rows with their own names.

A numbered name is a word that begins with a letter and holds a digit, so it is neither a keyword nor a name that a parser knows. Two texts are of one
shape if all else is the same, and their names are as long and equal one another at the same places: then all numbers of their rows are the same, and
strings differ in those names only. What isn't ASCII, is long or has very many names is parsed as it stands. A process keeps a bounded number of shapes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa

LONG, NAMES, SHAPES, CELLS = 8192, 128, 4096, 400_000  # characters and names of a text, shapes and cells that are kept
FRAME_ROWS = 20_000  # that leave a task at once
_NAME = re.compile(r"\b([A-Za-z][A-Za-z_]*+\d\w*+)", re.ASCII)


class _Shape:
    """The columns of a text, with the places where its names stand."""

    def __init__(self, columns: list[list], names: list[str]) -> None:
        at = {w: names.index(w) for w in names}
        self.columns = columns
        self.holes: list[tuple[int, list[tuple[int, int]], list[tuple[int, Callable]]]] = []  # of the columns that have names

        def filler(text: str) -> Callable[..., str]:
            parts = _NAME.split(text.replace("{", "{{").replace("}", "}}"))
            parts[1::2] = [f"{{{at[w]}}}" for w in parts[1::2]]  # a KeyError tells of a name from elsewhere
            return "".join(parts).format

        for k, column in enumerate(columns):
            whole, parted = [], []
            for i, cell in enumerate(column):
                if isinstance(cell, str) and cell in at:
                    whole.append((i, at[cell]))
                elif isinstance(cell, str) and _NAME.search(cell):
                    parted.append((i, filler(cell)))
                elif isinstance(cell, (list, tuple)) and any(isinstance(x, str) and _NAME.search(x) for x in cell):
                    fill = [filler(x) for x in cell]
                    parted.append((i, lambda *own, fill=fill, kind=type(cell): kind(f(*own) for f in fill)))
            if whole or parted:
                self.holes.append((k, whole, parted))

    def filled(self, names: list[str]) -> list[list]:
        out = self.columns.copy()
        for c, whole, parted in self.holes:
            out[c] = column = out[c].copy()
            for i, k in whole:
                column[i] = names[k]
            for i, fill in parted:
                column[i] = fill(*names)
        return out


class Shapes:
    """``make`` gives the columns of a text; what it raises, it raises. ``odd`` tells of texts that are always parsed."""

    def __init__(self, make: Callable[[str], list[list]], odd: Callable[[str], object]) -> None:
        self.make, self.odd, self.number = make, odd, len(_readers)

    def columns(self, text: str) -> list[list]:
        """The columns of ``text``; whoever takes them doesn't change them."""
        shape = _known.get((self.number, text))  # without names, a text is its shape
        if isinstance(shape, _Shape):
            return shape.columns
        if len(text) > LONG or not text.isascii() or self.odd(text):
            return self.make(text)
        parts = _NAME.split(text)
        names = parts[1::2]
        if len(names) > NAMES:
            return self.make(text)
        key = (self.number, *parts[::2], *map(len, names), *map(names.index, names))
        shape = _known.get(key)
        if isinstance(shape, _Shape):
            return shape.filled(names)
        out = self.make(text)
        if shape is None:  # most texts come once
            if len(_known) >= SHAPES or sum(_cells) > CELLS:
                _known.clear()
                _cells.clear()
            _known[key] = False
        elif shape is False:
            try:
                _known[key] = _Shape(out, names)
            except KeyError:
                _known[key] = True
            else:
                _cells[:] = [sum(_cells) + sum(map(len, out))]
        return out


#: Of the process: its shapes by reader and text (False: seen once, True: to be parsed always), how many cells they hold, its readers.
_known: dict[tuple, _Shape | bool] = {}
_cells: list[int] = []
_readers: dict[tuple, Shapes] = {}


def shapes(what: tuple, make: Callable[[str], list[list]], odd: Callable[[str], object]) -> Shapes:
    """The reader of ``what``, which says all that ``make`` goes by; its shapes outlive a task."""
    if what not in _readers:
        _readers[what] = Shapes(make, odd)
    return _readers[what]


def frames(batches: Iterator[pa.RecordBatch], columns_of: Callable[..., list[list]], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Batches of rows from many small files together. A file is its path and what ``columns_of`` takes, which gives all ``fields`` but the
    path; the path stands where ``fields`` have it."""
    held: list[list] = [[] for _ in fields]
    at = next((i for i, (name, _) in enumerate(fields) if name == "path"), None)
    others = [h for i, h in enumerate(held) if i != at]

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(h, kind) for h, (_, kind) in zip(held, fields, strict=True)], names=[name for name, _ in fields])
        for h in held:
            h.clear()
        return out

    for b in batches:
        for path, *file in zip(*(c.to_pylist() for c in b.columns), strict=True):
            columns = columns_of(*file)
            for h, column in zip(others, columns, strict=True):
                h += column
            if at is not None:
                held[at] += [path] * len(columns[0])
            if len(held[0]) >= FRAME_ROWS:
                yield batch()
    if held[0]:
        yield batch()
