"""Repeated 100-byte strings across a corpus, by bucket-pointer refinement over sampled q-grams.

Suffixes are first put in buckets by a q-gram. Only sampled ones enter: of each 100-byte window the
q-gram with the smallest hash, so that two equal windows sample the same place. The hashes are built by
doubling, a place's 2k-gram from the identifiers of the k-grams at it and k places on. Buckets of one
member are done; the others are refined by sorting on the 8-grams at later (and earlier) offsets, each
step starting from the bucket pointers of the one before, until all bytes of the windows are compared;
of equal windows the first start stays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blobs
from .common import partitions, sliced, text_bytes
from .textkernel import mix

GRAM = 40
#: Texts are dealt to bins of about so many bytes, of which a task holds one at a time.
BIN_BYTES = 64 << 20
MOST_BINS = 64  #: for each task, whatever the planner takes the size to be
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit identifier of the 40-gram at every place: 8-, 16-, 32-grams, then 32 + 8."""
    n = len(data) - 7
    eight = np.zeros(n, np.uint64)
    for i in range(8):
        eight |= data[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    with np.errstate(over="ignore"):
        eight = mix(eight)
        sixteen = (eight[:-8] * _A) ^ (eight[8:] * _B + (eight[8:] >> np.uint64(29)))
        big = (sixteen[:-16] * _A) ^ (sixteen[16:] * _B + (sixteen[16:] >> np.uint64(31)))
        m = len(data) - GRAM + 1
        return mix(big[:m] * _A ^ eight[32 : 32 + m])


def anchors(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text, place, gram, first, last): a row for each sampled gram; place is its byte in the text,
    first..last the starts of the windows that sample it."""
    starts = len(data) - width + 1
    none = np.zeros(0, np.int64)
    if starts <= 0:
        return none, none, none.view(np.uint64), none, none
    grams = _gram_hashes(data)
    span = width - GRAM + 1
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    reach, least = 1, low
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    place = (least[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(starts), "right") - 1
    good = np.arange(starts) + width <= offsets[text + 1]
    window = np.flatnonzero(good)
    place, text = place[window], text[window]
    if not len(window):
        return none, none, none.view(np.uint64), none, none
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(window)])) - 1
    text, place = text[head], place[head]
    begin = offsets[text]
    return text, place - begin, grams[place], window[head] - begin, window[tail] - begin


def first_starts(gram: np.ndarray, order: np.ndarray, context: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """For each row a boolean by offset o (0..width - GRAM): whether its window that holds the gram at
    offset o also starts earlier, in a row of smaller order with the same gram.

    context: bytes around the gram, width - GRAM on its left, and from its first byte on ``width``. Rows
    that agree in so many bytes to the right, or to the left, have one pointer; a window's class is the
    pair of both."""
    span = width - GRAM
    n = len(gram)
    later = np.zeros((n, span + 1), bool)
    bucket = np.unique(gram, return_inverse=True)[1]
    right, right_common = refined(bucket, context[:, span:])
    left, left_common = refined(bucket, context[:, :span][:, ::-1])
    for o in range(span + 1):
        rows = np.flatnonzero((low <= o) & (o <= high))
        if len(rows) < 2:
            continue
        key = pointers(left, left_common, o)[rows] * n + pointers(right, right_common, width - o)[rows]
        by = np.lexsort((order[rows], key))
        same = key[by][1:] == key[by][:-1]
        later[rows[by[1:][same]], o] = True
    return later


def refined(bucket: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows by bucket and then by their bytes, and for each place of that order how many
    first bytes its row shares with the one before; -1 where a bucket begins.

    Buckets are refined in steps of eight bytes: in a step the rows of buckets that still have several
    are sorted by their bucket's pointer and the 8-gram at the next offset. A pointer is the place in the
    order where a bucket begins, so a split leaves the pointers of all other buckets as they are."""
    n, size = data.shape
    words = -(-size // 8)
    padded = np.zeros((n, 8 * words), np.uint8)
    padded[:, :size] = data
    grams = padded.view(">u8")
    order = np.argsort(bucket, kind="stable")
    begins = np.concatenate(([True], bucket[order][1:] != bucket[order][:-1])) if n else np.zeros(0, bool)
    common = np.where(begins, -1, size)
    for step in range(words):
        pointer = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        alone = begins & np.concatenate((begins[1:], [True])) if n else begins
        active = np.flatnonzero(~alone)
        if not len(active):
            break
        rows = order[active]
        word = grams[rows, step].astype(np.uint64)
        by = np.lexsort((word, pointer[active]))
        order[active] = rows[by]
        word = word[by]
        split = np.flatnonzero((word[1:] != word[:-1]) & ~begins[active[1:]])
        differ = word[split + 1] ^ word[split]
        same = np.zeros(len(split), np.int64)
        for k in range(1, 8):
            same += differ < np.uint64(1) << np.uint64(64 - 8 * k)
        common[active[split + 1]] = np.minimum(8 * step + same, size)
        begins[active[split + 1]] = True
    return order, common


def pointers(order: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """For each row a number that rows of its bucket share if their first ``length`` bytes are equal."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < length)
    return out


_SPANS = "doc_id long, text string, starts array<long>, ends array<long>"


def repeated_spans(docs: DataFrame, width: int = 100, then=None, schema: str = _SPANS) -> DataFrame:
    """docs: doc_id, text. Returns one row per document: doc_id, text, starts, ends (arrays of bigint):
    the maximal runs of bytes covered by strings of ``width`` bytes that also start earlier, in a row
    with a smaller doc_id or before in the text. Null text is empty; rows with one doc_id stand in
    the order of a hash of their texts; null doc_ids come first. Repeated rows are all but the first
    one repeats. then: a function of such a record batch to one of ``schema``, run in the same worker.

    Texts are dealt out by a hash of (doc_id, text) once; both steps that read them reuse that
    exchange. Sampled grams, contexts and spans travel as arrays, one row for each pair of tasks.
    In a task's texts, rows that agree in gram and context are settled before the shuffle, so a passage
    in very many documents sends one row for each task, not one for each document."""
    spark = docs.sparkSession
    n = partitions(spark)
    # the planner's size of the files; texts take about three times as much as they do there
    size = min(3 * int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), MOST_BINS * BIN_BYTES * n)
    bins = n * max(1, -(-size // (BIN_BYTES * n)))
    span = width - GRAM
    # ord: documents compare by (doc_id, hash); packed as two 64-bit words that sort as unsigned
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("doc_id", "text").alias("th"))
    source = source.withColumn("bin", F.pmod("th", F.lit(bins)).cast("int"))
    dealt = source.repartition(n, "bin")

    def dealt_by(frame: DataFrame) -> DataFrame:
        """By target; in its order only where a task has many of them: a sort holds rows of megabytes."""
        frame = frame.repartition(n, "t")
        return frame.sortWithinPartitions("t") if bins > n else frame

    def targets(batches):
        """(whether settled, batches) of one target after another, or of a task's few targets together."""
        if bins > n:
            for target, parts, _ in blobs.runs(batches, 1 << 62):
                yield target < 0, parts
            return
        held = []
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            if (at < 0).any():
                yield True, [batch.filter(pa.array(at < 0))]
                batch = batch.filter(pa.array(at >= 0))
            if batch.num_rows:
                held.append(batch)
        if held:
            yield False, held

    def order_words(batch) -> tuple[np.ndarray, np.ndarray]:
        ids = batch.column(0)
        raw = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)
        return raw, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)

    def sample(batches):
        """Texts to grams: (target by gram: gram, doc word, hash word, place, bin)."""

        def pieces():
            for whole in batches:
                for piece in sliced(whole, "text"):
                    data, offsets = text_bytes(piece.column(1))
                    text, place, gram, first, last = anchors(data, offsets, width)
                    if not len(text):
                        continue
                    d, h = order_words(piece)
                    b = piece.column(3).to_numpy(zero_copy_only=False)
                    yield (gram % np.uint64(bins)).astype(np.int64), [gram, d[text], h[text], place.astype("<u4"), b[text].astype("<i4")]

        yield from blobs.flushing(pieces(), ["t", "gram", "d", "h", "place", "bin"])
        blobs.give_back()

    grams = source.mapInArrow(sample, "t int, gram binary, d binary, h binary, place binary, bin binary")

    def repeated(batches):
        """Grams that occur twice, back to their texts' bins: (bin: gram, doc word, hash word, place)."""
        for _, parts in targets(batches):
            gram, d, h, place, b = blobs.read(parts, ["<u8", "<u8", "<u8", "<u4", "<i4"])
            by = np.argsort(gram, kind="stable")
            g = gram[by]
            same = np.zeros(len(g), bool)
            equal = g[1:] == g[:-1]
            same[1:] |= equal
            same[:-1] |= equal
            by = by[same]
            if len(by):
                yield from blobs.flushing([(b[by].astype(np.int64), [d[by], h[by], place[by]])], ["bin", "d", "h", "place"])

    found = dealt_by(grams).mapInArrow(repeated, "bin int, d binary, h binary, place binary")

    def contexts(key, texts, hits):
        """The texts of a bin and its repeated places: contexts to the grams' targets, and at once the
        windows that are settled in the bin. Rows: (t, gram, d, h, copy, first, last, place, context, settled)."""
        d, h, place = _concat(hits, ["<u8", "<u8", "<u4"])
        names = ["t", "gram", "d", "h", "copy", "low", "high", "place", "context", "settled"]
        out = []
        if len(d) and texts.num_rows:
            wanted = _places(d, h, place)
            seen: dict[tuple, int] = {}
            parts = []
            for whole in texts.to_batches(max_chunksize=1000):
                for piece in sliced(whole, "text"):
                    dw, hw = order_words(piece)
                    keep = [i for i, x in enumerate(zip(dw.tolist(), hw.tolist())) if x in wanted]
                    if not keep:
                        continue
                    piece = piece.take(pa.array(keep))
                    dw, hw = dw[keep], hw[keep]
                    copy = np.zeros(len(keep), np.uint32)  # repeated rows get numbers
                    for i, x in enumerate(zip(dw.tolist(), hw.tolist())):
                        copy[i] = seen[x] = seen.get(x, -1) + 1
                    data, offsets = text_bytes(piece.column(1))
                    text, at, gram, first, last = anchors(data, offsets, width)
                    hit = np.zeros(len(text), bool)
                    for i, (x, a, b) in enumerate(zip(zip(dw.tolist(), hw.tolist()), np.searchsorted(text, np.arange(len(keep))).tolist(), np.searchsorted(text, np.arange(1, len(keep) + 1)).tolist())):
                        hit[a:b] = np.isin(at[a:b], wanted[x])
                    text, at, gram, first, last = text[hit], at[hit], gram[hit], first[hit], last[hit]
                    padded = np.concatenate((np.zeros(span, np.uint8), data, np.zeros(width, np.uint8)))
                    around = padded[(offsets[text] + at)[:, None] + np.arange(span + width)]
                    parts.append((gram, dw[text], hw[text], copy[text], (at - last).astype(np.int32), (at - first).astype(np.int32), at.astype("<u4"), around))
            if parts:
                gram, dw, hw, copy, low, high, at, around = (np.concatenate(x) for x in zip(*parts))
                # low..high: the offsets of the gram in the windows that sample it; bytes outside them don't count
                column = np.arange(span + width)
                around[(column < (span - high)[:, None]) | (column >= (span + width - low)[:, None])] = 0
                settled = _settle(gram, dw, hw, copy, at, low, high, around)
                out = [((gram % np.uint64(bins)).astype(np.int64), [gram, dw, hw, copy, low, high, at, around, settled.astype(np.uint8)])]
        rows = []
        if out:
            target, arrays = out[0]
            free = arrays[-1] == 0
            rows += blobs.by_target(target[free], [a[free] for a in arrays])
            done = ~free
            if done.any():  # settled ones only need to come back: their windows all start earlier
                rows += [(int(-1 - key[0].as_py()), [np.ascontiguousarray(a[done]).tobytes() if i != 7 else b"" for i, a in enumerate(arrays)])]
        blobs.give_back()
        if rows:
            return pa.Table.from_batches([blobs.batch(rows, names)])
        return pa.table([pa.array([], pa.int32()), *(pa.array([], pa.binary()) for _ in names[1:])], names=names)

    kinds = ["<u8", "<u8", "<u8", "<u4", "<i4", "<i4", "<u4", ("u1", span + width), "u1"]
    around_as = "t int, gram binary, d binary, h binary, copy binary, low binary, high binary, place binary, context binary, settled binary"
    around = dealt.groupBy("bin").cogroup(found.groupBy("bin")).applyInArrow(contexts, around_as)

    def removed(batches):
        """Classes of equal windows: (bin: doc word, hash word, copy, start, end) of what is covered."""
        names = ["bin", "d", "h", "copy", "start", "end"]

        def pieces():
            for settled, parts in targets(batches):
                if settled:  # runs of all windows that sample the gram
                    for part in parts:
                        gram, d, h, copy, low, high, place = blobs.read([part], kinds[:7])
                        start = place.astype(np.int64) - high
                        end = place.astype(np.int64) - low + width
                        yield (h.view(np.int64) % bins).astype(np.int64), [d, h, copy, start.astype("<u4"), end.astype("<u4")]
                    continue
                gram, d, h, copy, low, high, place, context, _ = blobs.read(parts, kinds)
                parts.clear()
                order = np.empty(len(gram), np.int64)
                order[np.lexsort((place, copy, h, d))] = np.arange(len(gram))
                by = np.argsort(gram, kind="stable")
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(gram[by])) + 1, [len(by)]))
                a = 0
                while a < len(by):  # whole buckets, some thousand rows at once
                    b = int(cuts[max(np.searchsorted(cuts, a + 16384, "right") - 1, np.searchsorted(cuts, a, "right"))])
                    own = by[a:b]
                    a = b
                    rows, offset = np.nonzero(first_starts(gram[own], order[own], context[own], low[own], high[own], width))
                    if not len(rows):
                        continue
                    rows = own[rows]  # neighbouring offsets are one run
                    new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (offset[1:] != offset[:-1] + 1)))
                    head = np.flatnonzero(new)
                    tail = np.concatenate((head[1:], [len(rows)])) - 1
                    r = rows[head]
                    start = place[r].astype(np.int64) - offset[tail]
                    end = place[r].astype(np.int64) - offset[head] + width
                    yield (h[r].view(np.int64) % bins).astype(np.int64), [d[r], h[r], copy[r], start.astype("<u4"), end.astype("<u4")]

        yield from blobs.flushing(pieces(), names)
        blobs.give_back()

    spans = dealt_by(around).mapInArrow(removed, "bin int, d binary, h binary, copy binary, start binary, end binary")

    def joined(key, texts, runs):
        d, h, copy, start, end = _concat(runs, ["<u8", "<u8", "<u4", "<u4", "<u4"])
        by = np.lexsort((end, start, copy, h, d))
        d, h, copy, start, end = d[by], h[by], copy[by], start[by].astype(np.int64), end[by].astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (copy[1:] != copy[:-1])))) if len(d) else np.zeros(0, np.int64)
        last = np.concatenate((new[1:], [len(d)])) if len(d) else new
        where = {(int(d[a]), int(h[a]), int(copy[a])): (a, b) for a, b in zip(new.tolist(), last.tolist())}
        seen: dict[tuple, int] = {}
        starts, ends = [], []
        dw, hw = order_words(texts.combine_chunks().to_batches()[0]) if texts.num_rows else (np.zeros(0, np.uint64),) * 2
        for x in zip(dw.tolist(), hw.tolist()):
            c = seen[x] = seen.get(x, -1) + 1
            a, b = where.get((*x, c), (0, 0))
            if a == b:
                starts.append([])
                ends.append([])
                continue
            s, e = start[a:b], np.maximum.accumulate(end[a:b])
            gap = np.flatnonzero(s[1:] > e[:-1]) + 1
            starts.append(s[np.concatenate(([0], gap))].tolist())
            ends.append(e[np.concatenate((gap - 1, [len(e) - 1]))].tolist())
        kind = pa.list_(pa.int64())
        out = pa.table([texts.column(0), texts.column(1), pa.array(starts, kind), pa.array(ends, kind)], names=["doc_id", "text", "starts", "ends"])
        if then is not None:
            out = pa.Table.from_batches([then(b) for b in out.to_batches(max_chunksize=1000)] or [then(pa.RecordBatch.from_pylist([], out.schema))])
        blobs.give_back()
        return out

    return dealt.groupBy("bin").cogroup(spans.groupBy("bin")).applyInArrow(joined, schema)


def _concat(table: pa.Table, kinds: list[str]) -> list[np.ndarray]:
    return blobs.read(table.to_batches(), kinds)


def _places(d: np.ndarray, h: np.ndarray, place: np.ndarray) -> dict:
    """The wanted places by document."""
    by = np.lexsort((place, h, d))
    d, h, place = d[by], h[by], place[by]
    new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]))))
    last = np.concatenate((new[1:], [len(d)]))
    return {(int(d[a]), int(h[a])): place[a:b] for a, b in zip(new.tolist(), last.tolist())}


def _settle(gram, d, h, copy, place, low, high, around) -> np.ndarray:
    """Rows whose gram, offsets and context an earlier row of these has too."""
    with np.errstate(over="ignore"):
        key = mix(gram ^ (low.astype(np.uint64) << np.uint64(32)) ^ high.astype(np.uint64))
        for k in range(around.shape[1]):
            key = (key ^ (around[:, k].astype(np.uint64) + np.uint64(1))) * _B
            key ^= key >> np.uint64(32)
    by = np.lexsort((place, copy, h, d, key))
    one, two = by[:-1], by[1:]
    near = np.flatnonzero(key[one] == key[two])
    one, two = one[near], two[near]  # equal hashes: then the bytes decide
    same = (gram[one] == gram[two]) & (low[one] == low[two]) & (high[one] == high[two])
    for a in range(0, len(one), 1 << 14):
        part = slice(a, a + (1 << 14))
        same[part] &= (around[one[part]] == around[two[part]]).all(axis=1)
    out = np.zeros(len(key), bool)
    out[two[same]] = True
    return out


def _kept(batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, texts, starts, ends = (batch.column(i) for i in range(4))
    data, offsets = text_bytes(texts)
    n, gone, spans, digest = [], [], [], []
    for i, (s, e) in enumerate(zip(starts.to_pylist(), ends.to_pylist())):
        own = memoryview(data[offsets[i] : offsets[i + 1]])
        sha, at = hashlib.sha256(), 0
        for a, b in zip(s, e):
            sha.update(own[at:a])
            at = b
        sha.update(own[at:])
        n.append(len(own))
        gone.append(sum(e) - sum(s))
        spans.append(len(s))
        digest.append(sha.hexdigest())
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' removed bytes and a digest of the rest; null and short texts lose nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_spans(docs, then=_kept, schema="doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
