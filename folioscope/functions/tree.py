"""Elements that nest: which one holds which."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.xml import as_column

NODES = "array<struct<tag: string, path: array<int>, own: string>>"
ARROW_NODES = pa.list_(pa.struct([("tag", pa.string()), ("path", pa.list_(pa.int32())), ("own", pa.string())]))
# Texts whose elements are in a worker's memory at once; a batch has as many rows as the session says.
SLICE = 128


def _in_slices(read: Callable[[str], list], schema: str, arrow: pa.DataType):
    """A function of texts that hands its results on slice by slice, straight as Arrow arrays."""
    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, max(len(batch), 1), SLICE):
                yield pa.array([None if t is None else read(t) for t in batch.slice(at, SLICE).to_pylist()], type=arrow)

    return run


def tag_pattern(*tags: str) -> re.Pattern:
    """Opening and closing tags, and what hides them: comments and character data."""
    names = "|".join(map(re.escape, tags))
    return re.compile(rf"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(?P<close>/?)(?P<tag>{names})(?=[\s/>])[^>]*?(?P<empty>/?)>", re.DOTALL)


def nodes_of(text: str, token: re.Pattern) -> list[tuple[str, list[int], str]]:
    """Elements in the order of their opening tags.

    ``path`` are the positions of the enclosing elements, outermost first; ``own`` is the
    element's markup without that of elements inside it. A closing tag ends the nearest open element of its name and what is still open
    in it; one without such an element is no tag. Elements left open end with the text.
    """
    tags: list[str] = []
    paths: list[list[int]] = []
    own: list[list[str]] = []
    stack: list[int] = []
    at = 0
    for m in token.finditer(text):
        close, tag, empty = m.groups()
        if tag is None:  # a comment or character data
            continue
        start, end = m.span()
        if not close:
            if stack:
                own[stack[-1]].append(text[at:start])
            if not empty:
                stack.append(len(tags))
            tags.append(tag)
            paths.append(stack[:] if empty else stack[:-1])
            own.append([text[start:end]])
            at = end
        elif any(tags[i] == tag for i in reversed(stack)) if stack and tags[stack[-1]] != tag else stack:
            if tags[stack[-1]] != tag:
                own[stack[-1]].append(text[at:start])
                at = start
                while tags[stack[-1]] != tag:
                    stack.pop()
            own[stack.pop()].append(text[at:end])
            at = end
    if stack:
        own[stack[-1]].append(text[at:])
    return [(tag, path, "".join(pieces)) for tag, path, pieces in zip(tags, paths, own)]


def element_tree(xml, *tags: str) -> Column:
    """``array<struct<tag, path, own>>`` of the elements with these tags; one pass over the text.

    Which element a closing tag belongs to is the state of a stack, which no pattern can keep.
    """
    token = tag_pattern(*tags)

    return _in_slices(lambda text: nodes_of(text, token), NODES, ARROW_NODES)(as_column(xml))


TABLES = "array<struct<parent: int, parent_row: int, parent_col: int, rows: array<array<string>>>>"
ARROW_TABLES = pa.list_(pa.struct([*[(name, pa.int32()) for name in ("parent", "parent_row", "parent_col")], ("rows", pa.list_(pa.list_(pa.string())))]))


def tables_of(nodes: list[tuple[str, list[int], str]], table: str, row: str, cell: str) -> list[tuple]:
    """Tables in order with the cell that holds them and the own markup of their cells; what has no cells drops."""
    rows: dict[int, list[int]] = {i: [] for i, (tag, _, _) in enumerate(nodes) if tag == table}
    cells: dict[int, list[int]] = {}
    for i, (tag, path, _) in enumerate(nodes):
        if path and tag == row and path[-1] in rows:
            rows[path[-1]].append(i)
            cells[i] = []
        elif path and tag == cell and path[-1] in cells:
            cells[path[-1]].append(i)
    kept = {t: [cells[r] for r in found if cells[r]] for t, found in rows.items()}
    numbers = {t: n for n, t in enumerate(t for t, found in kept.items() if found)}
    place = {c: (numbers[t], y, x) for t, found in kept.items() if found for y, line in enumerate(found) for x, c in enumerate(line)}
    return [(*place.get(nodes[t][1][-1] if nodes[t][1] else -1, (None, None, None)), [[nodes[c][2] for c in line] for line in kept[t]]) for t in numbers]


def table_tree(xml, table: str, row: str, cell: str) -> Column:
    """``array<struct<parent, parent_row, parent_col, rows>>`` of the tables of a part, tables inside cells too."""
    token = tag_pattern(table, row, cell)

    return _in_slices(lambda text: tables_of(nodes_of(text, token), table, row, cell), TABLES, ARROW_TABLES)(as_column(xml))
