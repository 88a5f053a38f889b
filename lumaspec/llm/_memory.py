"""Memory of Python workers, which are used again for other stages and so hold what they once took."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa


def handled(batches: Iterable[pa.RecordBatch], work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What ``work`` gives for each batch in turn. A batch is let go before the next is asked for, and when
    the last has gone, the memory that Arrow keeps for later goes back."""
    batches = iter(batches)
    while (batch := next(batches, None)) is not None:
        yield from work(batch)
        del batch
    pa.default_memory_pool().release_unused()
