"""Arrays that travel through a shuffle as bytes: one row for each pair of tasks, not one for each entry."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system between the tasks of a worker."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def by_target(target: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """(target, [bytes of each array]) for all targets that have entries."""
    small = len(target) and int(target.min()) >= 0 and int(target.max()) < 1 << 16
    by = np.argsort(target.astype(np.uint16) if small else target, kind="stable")  # small numbers are sorted by radix
    sorted_ = target[by]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(sorted_)) + 1, [len(by)])) if len(by) else np.zeros(1, np.int64)
    arrays = [a[by] for a in arrays]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(sorted_[a]), [np.ascontiguousarray(x[a:b]).tobytes() for x in arrays]


def batch(rows: list[tuple[int, list[bytes]]], names: list[str]) -> pa.RecordBatch:
    """A record batch of by_target's rows; names: the target's, then the arrays'."""
    cols = list(zip(*((t, *blobs) for t, blobs in rows)))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=names)


def flushing(pieces: Iterable[tuple[np.ndarray, list[np.ndarray]]], names: list[str], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """pieces: (targets, arrays). Gathers about ``most`` bytes of them at a time and yields their blobs."""
    held: list = []
    size = 0
    for target, arrays in pieces:
        held.append((target, arrays))
        size += sum(a.nbytes for a in arrays)
        if size >= most:
            yield from _out(held, names)
            held, size = [], 0
    if held:
        yield from _out(held, names)


def _out(held: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    target = np.concatenate([t for t, _ in held])
    arrays = [np.concatenate([a[i] for _, a in held]) for i in range(len(held[0][1]))]
    rows = list(by_target(target, arrays))
    if rows:
        yield batch(rows, names)


def read(batches: Iterable[pa.RecordBatch], kinds: list) -> list[np.ndarray]:
    """All blobs of some batches by column, as arrays of these kinds; the first column is the target."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for one in batches:
        for i in range(len(kinds)):
            column = one.column(i + 1)
            if len(column):
                _, offsets, data = column.buffers()
                marks = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
                if marks[-1] > marks[0]:
                    parts[i].append(np.frombuffer(data, np.uint8)[marks[0] : marks[-1]])
    raw = [np.concatenate(p) if p else np.zeros(0, np.uint8) for p in parts]
    return [r.view(k[0]).reshape(-1, k[1]) if isinstance(k, tuple) else r.view(k) for r, k in zip(raw, kinds)]


def runs(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[pa.RecordBatch], bool]]:
    """Batches sorted by target, as (target, its slices, whether these are all). A target of more than
    ``most`` bytes comes in parts, so that no more than that is held."""
    current, waiting, size, whole = None, [], 0, True
    for one in batches:
        target = one.column(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(target)) + 1, [len(target)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            if target[a] != current:
                if waiting:
                    yield current, waiting, whole
                current, waiting, size, whole = int(target[a]), [], 0, True
            part = one.slice(a, b - a)
            waiting.append(part)
            size += part.nbytes
            if size > most:
                whole = False
                yield current, waiting, whole
                waiting, size = [], 0
    if waiting:
        yield current, waiting, whole
