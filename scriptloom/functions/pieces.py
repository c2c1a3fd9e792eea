"""Arrow batches in pieces of bounded size.

Spark fills a batch with up to 10,000 rows or 64 MB. As Python objects, with what is made of them, that is
several times as much in every task, and a query with many functions has many workers. A function that takes a
batch piece by piece, and yields what each became, holds one piece as objects, however large the table is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Bytes of a piece; a single row may be longer.
PIECE_BYTES = 1 << 20


def pieces(arrays: tuple[pa.Array, ...], limit: int | None = None) -> Iterator[tuple[pa.Array, ...]]:
    """Columns of one length cut into runs of rows of at most ``limit`` bytes; none is copied."""
    limit = limit or PIECE_BYTES
    n = len(arrays[0])
    if n <= 1 or sum(a.nbytes for a in arrays) <= limit:
        yield arrays
        return
    yield from pieces(tuple(a.slice(0, n // 2) for a in arrays), limit)
    yield from pieces(tuple(a.slice(n // 2) for a in arrays), limit)


def piecewise(batches: Iterable[pa.Array | tuple[pa.Array, ...]], work: Callable[..., pa.Array]) -> Iterator[pa.Array]:
    """What ``work`` makes of each piece of each batch, in order."""
    for batch in batches:
        for piece in pieces(batch if isinstance(batch, tuple) else (batch,)):
            yield work(*piece)


def by_row(batches: Iterable[pa.Array | tuple[pa.Array, ...]], function: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """The same for a Python function of a row's values."""
    return piecewise(batches, lambda *columns: pa.array([function(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], kind))
