"""Links between 64-bit fingerprints: pigeonhole plans, and bounded work inside hot buckets."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import give_back
from .common import materialize, partitions
from .textkernel import mix


def block_masks(blocks: int, chosen: int) -> list[int]:
    """64 bits cut into even blocks; a mask for each choice of blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [sum(own[i] for i in pick) for pick in combinations(range(blocks), chosen)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def exact_masks(distance: int, rows: int) -> list[int]:
    """Masks of which two fingerprints within ``distance`` agree on at least one: with b blocks, any
    b - distance of them that are equal. b grows with the rows, so that a key has more bits than there
    are rows to fill them; every choice is complete, only the cost differs."""
    blocks = distance + 1
    while 64 * (blocks - distance) / blocks < np.log2(max(rows, 2)) - 9:
        blocks += 1
    return block_masks(blocks, blocks - distance)


def deletion_keys(fp: Column, distance: int, rows: int) -> Column:
    """Keys of which two fingerprints within ``distance`` share at least one, by one-wildcard variants.

    The bits are cut into so few segments that one differs by at most one bit (three for a distance of
    4: 4 // 3 = 1); a segment is then indexed once for each of its bits, with that bit left out. Where
    the rows would overfill such keys, a segment is made of several of more, smaller blocks: among b
    blocks the b - distance + 1 least differing ones differ by at most one bit together."""
    masks = []
    segments = distance // 2 + 1
    if 64 / segments - 1 >= np.log2(max(rows, 2)) - 3:
        masks = block_masks(segments, 1)
    else:
        blocks = distance + 1
        while 64 * (blocks - distance + 1) / blocks - 1 < np.log2(max(rows, 2)) - 3 and blocks < distance + 4:
            blocks += 1
        masks = block_masks(blocks, blocks - distance + 1)
    keys = []
    for i, mask in enumerate(masks):
        for bit in range(64):
            if mask >> bit & 1:
                keys.append(F.xxhash64(F.lit(i * 64 + bit), fp.bitwiseAND(F.lit(signed(mask & ~(1 << bit))))))
    return F.array(*keys)


_LINKS = "a long, b long, hot long, chunk int, members binary"


#: Of some rows (columns by name) and two arrays of their indexes: which pairs may be linked.
Fits = Callable[[dict, np.ndarray, np.ndarray], np.ndarray]


#: Two arrays of indexes: which pairs are alike.
Decide = Callable[[np.ndarray, np.ndarray], np.ndarray]


#: So many pairs that ``verify`` leaves open are decided at once, more where few are alike.
MANY, MOST = 1024, 8192


def forest(
    fps: np.ndarray,
    distance: int,
    verify: Callable[[int, int], bool | None] | None = None,
    since: int = 0,
    earlier: list[int] = (),
    fits: Callable[[int, np.ndarray], np.ndarray] | None = None,
    label: np.ndarray | None = None,
    decide: Decide | None = None,
    left: list[tuple[int, int]] | None = None,
) -> list[tuple[int, int]]:
    """Pairs of indexes that span the links among fps (links: within distance, and verified).

    Row by row against all later ones, skipping what is joined already: no pair list is held.
    since: only pairs with one index below it and one from it on are compared, if it is set.
    earlier: masks; a pair that agrees on all bits of one of them shares a bucket there, and is left
    to it, so that no pair is verified twice. fits: which of some indexes may be like the first one.
    label: numbers that are equal for what is joined from the start. decide: which of many pairs are
    alike; those of which verify says None wait until they are MANY, and the last ones go to ``left`` if
    it is given."""
    n = len(fps)
    masks = [np.uint64(m) for m in earlier]

    def close(x: np.ndarray) -> np.ndarray:
        found = np.bitwise_count(x) <= distance
        for m in masks:
            found &= (x & m) != 0
        return found

    label = np.arange(n) if label is None else label
    out = []
    waiting: list[tuple[int, int]] = []

    many = MANY

    def join(i: int, j: int) -> None:
        if label[i] != label[j]:
            out.append((i, j))
            label[label == label[j]] = label[i]

    whole = None
    rows = range(since or n - 1)
    if not since and n <= 1024:  # one matrix, of which mostly no row has a link
        whole = np.triu(close(fps[:, None] ^ fps[None, :]), 1)
        rows = np.flatnonzero(whole.any(axis=1)).tolist()
    for i in rows:
        start = since or i + 1
        if whole is not None:
            near = np.flatnonzero(whole[i])
        else:
            near = np.flatnonzero(close(fps[start:] ^ fps[i])) + start
        near = near[label[near] != label[i]]
        if fits is not None and len(near):
            near = near[fits(i, near)]
        first = len(waiting)
        for j in near.tolist():
            if label[j] == label[i]:
                continue
            if len(waiting) - first >= 8 and sum(label[k] == label[j] for _, k in waiting[first : first + 8]) >= 4:
                waiting.append((i, j))  # one more pair between two sets that are tried anyway
                continue
            found = verify is None or verify(i, j)
            if found:
                join(i, j)
            elif found is None:
                waiting.append((i, j))
        if len(waiting) >= many:
            many = MANY if settle(waiting, lambda x: label[x], join, decide) > 1 / 8 else min(2 * many, MOST)
    if left is None:
        settle(waiting, lambda x: label[x], join, decide)
    else:
        left += waiting
    return out


def settle(waiting: list[tuple[int, int]], labels: Callable[[np.ndarray], np.ndarray], join: Callable[[int, int], None], decide: Decide | None) -> float:
    """Decide the pairs that wait, apart from those that have been joined by now. Of pairs between the same
    two joined sets one is tried first, then four times as many each time: most need no look in a large
    like set. Returns the share of the tried ones that are alike."""
    if not waiting:
        return 0.0
    i, j = np.array(waiting).T
    waiting.clear()
    most, tried, alike = 1, 0, 0
    while len(i):
        a, b = labels(i), labels(j)
        low, high = np.minimum(a, b), np.maximum(a, b)
        by = np.lexsort((high, low))
        by = by[low[by] != high[by]]
        edges = np.concatenate(([True], (low[by][1:] != low[by][:-1]) | (high[by][1:] != high[by][:-1])))[: len(by)]
        start = np.flatnonzero(edges)
        now = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by)))) < most
        one, two = i[by[now]], j[by[now]]
        if len(one):
            found = decide(one, two)
            tried, alike = tried + len(one), alike + int(found.sum())
            for x, y in zip(one[found].tolist(), two[found].tolist()):
                join(x, y)
        i, j = i[by[~now]], j[by[~now]]
        most *= 4
    return alike / max(1, tried)


def split_masks(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask``, cut into so many even masks."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    edges = [len(free) * i // parts for i in range(parts + 1)]
    return [sum(1 << bit for bit in free[edges[i] : edges[i + 1]]) for i in range(parts)]


#: Runs of so many equal finer keys are compared by shifts, longer ones row by row.
SHIFTS = 24


def many_buckets(
    keys: np.ndarray, fps: np.ndarray, tabs: np.ndarray, masks: list[int], distance: int, fits: Callable[[np.ndarray, np.ndarray], np.ndarray], sizes: np.ndarray
) -> list[tuple[int, int]]:
    """As forest, for many whole buckets at once, without a loop over buckets.

    The bits that a bucket's mask leaves free are cut into distance + 1 parts, of which close pairs
    agree on one: a bucket is read once for each part, in the order of that part, so the steps grow with
    its rows and not with their square."""
    parts = [split_masks(m, distance + 1) for m in masks]
    table = np.array(parts, np.uint64)
    joined = list(range(len(fps)))
    out: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while joined[i] != i:
            joined[i] = joined[joined[i]]
            i = joined[i]
        return i

    def join(i: int, j: int) -> None:
        out.append((i, j))
        joined[root(j)] = root(i)

    for s in range(distance + 1):
        fine = mix(keys.view(np.uint64) ^ mix(fps & table[tabs, s]))
        order = np.argsort(fine)
        fine, row, fp = fine[order], order, fps[order]
        edges = np.flatnonzero(np.concatenate(([True], fine[1:] != fine[:-1], [True])))
        long = np.flatnonzero(np.diff(edges) > SHIFTS)
        short = np.ones(len(fine), bool)
        for a, b in zip(edges[long].tolist(), edges[long + 1].tolist()):
            short[a:b] = False
        for shift in range(1, SHIFTS):
            at = np.flatnonzero((fine[shift:] == fine[:-shift]) & short[shift:])
            if not len(at):
                break
            x = fp[at] ^ fp[at + shift]
            ok = np.bitwise_count(x) <= distance
            at, x = at[ok], x[ok]
            i, j = row[at], row[at + shift]
            ok = fits(sizes[i], sizes[j])
            for e in range(s):
                ok &= (x & table[tabs[i], e]) != 0
            for t, m in enumerate(masks[:-1]):
                ok &= (x & np.uint64(m) != 0) | (tabs[i] <= t)
            for one, two in zip(i[ok].tolist(), j[ok].tolist()):
                if root(one) != root(two):
                    join(one, two)
        for a, b in zip(edges[long].tolist(), edges[long + 1].tolist()):
            own = row[a:b]
            tab = int(tabs[own[0]])
            fit = lambda i, near: fits(sizes[own[i]], sizes[own[near]])
            label = np.array([root(i) for i in own.tolist()])
            for i, j in forest(fp[a:b], distance, None, 0, [*masks[:tab], *parts[tab][:s]], fit, label):
                join(int(own[i]), int(own[j]))
    return out


def small_buckets(part: dict, distance: int, verify: Callable[[int, int], bool | None] | None, fits: Fits | None, decide: Decide | None = None) -> list[tuple[int, int]]:
    """As forest, for many whole buckets at once: pairs come from shifts of the rows, sorted by key,
    against themselves. Buckets of more than SHIFTS rows are compared row by row."""
    keys, fps = part["key"], part["fp"]
    joined = list(range(len(keys)))
    out: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while joined[i] != i:
            joined[i] = joined[joined[i]]
            i = joined[i]
        return i

    def join(i: int, j: int) -> None:
        if root(i) != root(j):
            out.append((i, j))
            joined[root(j)] = root(i)

    def labels(x: np.ndarray) -> np.ndarray:
        return np.array([root(i) for i in x.tolist()])

    waiting: list[tuple[int, int]] = []
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    length = np.diff(edges)
    short = np.repeat(length <= SHIFTS, length)
    for shift in range(1, min(SHIFTS, int(length.max(initial=1)))):
        at = np.flatnonzero((keys[shift:] == keys[:-shift]) & short[shift:])
        for a in range(0, len(at), 1 << 14):
            i = at[a : a + (1 << 14)]
            i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= distance]
            if fits is not None:
                i = i[fits(part, i, i + shift)]
            for one in i.tolist():
                if root(one) != root(one + shift):
                    found = verify is None or verify(one, one + shift)
                    if found:
                        join(one, one + shift)
                    elif found is None:
                        waiting.append((one, one + shift))
        if len(waiting) >= MANY:
            settle(waiting, labels, join, decide)
    for e in np.flatnonzero(length > SHIFTS).tolist():
        a, b = int(edges[e]), int(edges[e + 1])
        check = None if verify is None else lambda i, j: verify(a + i, a + j)
        fit = None if fits is None else lambda i, near: fits(part, np.full(len(near), a + i), a + near)
        both = None if decide is None else lambda i, j: decide(a + i, a + j)
        left: list[tuple[int, int]] = []
        for i, j in forest(fps[a:b], distance, check, 0, (), fit, None, both, left):
            join(a + i, a + j)
        waiting += [(a + i, a + j) for i, j in left]
    settle(waiting, labels, join, decide)
    return out


def bucket_links(
    keyed: DataFrame, distance: int, similar: Callable[[str, str], bool | None] | None = None, chunk: int = 32768, fits: Fits | None = None, sketch: Callable[[np.ndarray], np.ndarray] | None = None, decide: Callable[[list[str], list[str]], np.ndarray] | None = None
) -> DataFrame:
    """keyed: key (bigint), fp (bigint), id (bigint), text if ``similar`` is given, and size if ``fits``
    is. Returns a, b: ids whose links span those of every bucket of equal keys. fits: a vectorised test
    that pairs may be alike, before ``similar`` decides; it also sees a column sketch, made of the texts.
    decide: which pairs of the texts of two lists are similar; for those of which ``similar`` says None.

    Buckets are read one after another from sorted partitions. One of more than ``chunk`` members is
    cut into chunks, which a second step compares pair by pair: chunks are joined by bucket and number,
    so the pairs of a bucket are spread over all tasks, and none is capped."""
    spark = keyed.sparkSession
    n = partitions(spark)
    columns = ["key", "fp", "id"] + ["size"] * (fits is not None) + ["text"] * (similar is not None)

    def links_of(part: dict, since=0):
        """Of one bucket, or of two chunks of one."""
        fps, ids, texts = part["fp"], part["id"], part.get("text")
        check = None if similar is None else lambda i, j: similar(texts[i], texts[j])
        fit = None if fits is None else lambda i, near: fits(part, np.full(len(near), i), near)
        many = None if decide is None else lambda i, j: decide(texts[i].tolist(), texts[j].tolist())
        return [(int(ids[i]), int(ids[j])) for i, j in forest(fps, distance, check, since, (), fit, None, many)]

    def links_of_all(part: dict):
        """Of many whole buckets."""
        ids, texts = part["id"], part.get("text")
        check = None if similar is None else lambda i, j: similar(texts[i], texts[j])
        many = None if decide is None else lambda i, j: decide(texts[i].tolist(), texts[j].tolist())
        return [(int(ids[i]), int(ids[j])) for i, j in small_buckets(part, distance, check, fits, many)]

    def cut(part: dict, a: int, b: int | None = None) -> dict:
        return {k: v[a:b] for k, v in part.items()}

    def columns_of(batch) -> dict:
        part = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
        made = {"fp": part["fp"].view(np.uint64)} | ({} if sketch is None else {"sketch": sketch(part["text"])})
        return part | made

    def dump(part: dict) -> bytes:
        t = pa.table({k: pa.array(v.view(np.int64)) if k == "fp" else pa.array(v) for k, v in part.items() if k != "sketch"})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        return sink.getvalue().to_pybytes()

    def load(raw: bytes) -> dict:
        return columns_of(pa.ipc.open_stream(raw).read_all().combine_chunks().to_batches()[0])

    def emit(links, hot=()):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in links] + [None] * len(hot), pa.int64()),
                pa.array([x[1] for x in links] + [None] * len(hot), pa.int64()),
                pa.array([None] * len(links) + [h[0] for h in hot], pa.int64()),
                pa.array([None] * len(links) + [h[1] for h in hot], pa.int32()),
                pa.array([None] * len(links) + [h[2] for h in hot], pa.binary()),
            ],
            names=["a", "b", "hot", "chunk", "members"],
        )

    def run(batches):
        held = None  # the bucket that may go on in the next batch
        at = 0  # chunks of it that have been sent
        for batch in batches:
            part = columns_of(batch)
            if not len(part["key"]):
                continue
            if held is not None:
                part = {k: np.concatenate((held[k], v)) for k, v in part.items()}
            keys = part["key"]
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            links, hot = [], []
            begin, last = 0, int(cuts[-1]) if len(cuts) else 0  # the last bucket waits
            if at and last:  # the rest of a bucket that has been sent in chunks
                begin = int(cuts[0])
                hot.append((int(keys[0]), at, dump(cut(part, 0, begin))))
            if last:
                at = 0
            edges = np.concatenate(([begin], cuts[(cuts > begin) & (cuts <= last)])) if last > begin else np.zeros(1, np.int64)
            for e in np.flatnonzero(np.diff(edges) > chunk).tolist():  # whole buckets that are too large for one task
                a, b = int(edges[e]), int(edges[e + 1])
                hot += [(int(keys[a]), i, dump(cut(part, x, min(x + chunk, b)))) for i, x in enumerate(range(a, b, chunk))]
            small = np.repeat(np.diff(edges) <= chunk, np.diff(edges))
            if small.any():
                links = links_of_all({k: v[begin:last][small] for k, v in part.items()})
            while len(keys) - last > chunk:
                hot.append((int(keys[last]), at, dump(cut(part, last, last + chunk))))
                last, at = last + chunk, at + 1
            held = cut(part, last)
            if links or hot:
                yield emit(links, hot)
        if held is not None and len(held["key"]):
            if at:
                yield emit([], [(int(held["key"][0]), at, dump(held))])
            elif len(held["key"]) > 1:
                yield emit(links_of(held))
        give_back()

    found, _ = materialize(
        keyed.select(*columns).repartition(n, "key").sortWithinPartitions("key", "id").mapInArrow(run, _LINKS), "links"
    )
    links = found.where("a is not null").select("a", "b")
    chunks = found.where("hot is not null").select("hot", "chunk", "members")
    if chunks.isEmpty():
        return links.distinct()
    last = chunks.groupBy("hot").agg(F.max("chunk").alias("last"))
    pairs = last.select("hot", "last", F.explode(F.sequence(F.lit(0), "last")).alias("chunk")).select("hot", "chunk", F.explode(F.sequence("chunk", "last")).alias("chunk2"))
    other = chunks.select("hot", F.col("chunk").alias("chunk2"), F.col("members").alias("members2"))
    both = pairs.join(chunks, ["hot", "chunk"]).join(other, ["hot", "chunk2"])

    def across(batches):
        for batch in batches:
            for c, one, d, two in zip(*(batch.column(i).to_pylist() for i in range(4))):
                part = load(one)
                if c == d:
                    yield emit(links_of(part))
                else:
                    more = load(two)
                    yield emit(links_of({k: np.concatenate((v, more[k])) for k, v in part.items()}, len(part["key"])))

    more = both.select("chunk", "members", "chunk2", "members2").repartition(n).mapInArrow(across, _LINKS)
    return links.union(more.select("a", "b")).distinct()
