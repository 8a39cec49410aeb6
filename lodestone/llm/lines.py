"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one line kept.

Two lines are alike from an edit similarity of MIN_SIMILARITY on. Blocks of their 64-bit SimHashes bring
those within DISTANCE bits together; but a word in ten that differs turns about nine bits, more than
any join on blocks of 64 bits can span. So the pigeonhole principle is also used on the lines themselves:
a few edits leave one of a line's blocks of words, or two of its quarters, as they were."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blobs
from .common import materialize, partitions, sliced, text_bytes, unused
from .components import connected_components
from .hamming import bucket_links, exact_masks, many_buckets
from .textkernel import FOLD, majority_bits, mix, range_hash, range_sums, sequence_hash, words

MIN_SIMILARITY = 0.8
DISTANCE = 4
#: Lines of so many characters are alike only if their SimHashes differ in at most so many bits: with one
#: word in five replaced they differ in 18 on average, without words in common in 32.
LENGTHY, NEAR = 60, 26
#: A line of fewer words is taken character by character: headings, menus, scripts without spaces.
WORDY = 4
#: Lines of so many words, or characters, have plain blocks; shorter ones pairs of quarters, and halves.
LONG, LONG_SPELT = 16, 32
#: An exchange target whose entries take more bytes goes on row by row.
HOT_BYTES = 64 << 20
ENTRY_BYTES = 320  #: of a line's entries, about
#: Texts are cut so that their arrays, eight times as large, stay in a core's cache.
SLICE = 1 << 19


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, by Myers' bit vectors on whole integers. With ``most``, any number above
    it stands for a larger distance."""
    most = len(a) + len(b) if most is None else most
    while a and b and a[-1] == b[-1]:
        n = 1
        while n < min(len(a), len(b)) and a[-n - 1 :] == b[-n - 1 :] and n < 64:
            n *= 2
        n = n if a[-n:] == b[-n:] else 1
        a, b = a[:-n], b[:-n]
    low = 0
    for x, y in zip(a, b):
        if x != y:
            break
        low += 1
    a, b = a[low:], b[low:]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down = full, 0
    room = most - len(a) + len(b)  # what is left of most, if each place to come takes off one
    marks = [(i, (1 << i) - 1) for i in range(32, len(a), 32)] if most < len(a) else []
    for t, c in enumerate(b):
        if marks and t & 63 == 63:  # the way to the end leaves this column at some row, at most 32 off one of these
            off = len(a) - len(b) + t
            if min(t + abs(off), most - room + 2 * (len(b) - t), *(t + (up & m).bit_count() - (down & m).bit_count() + abs(off - i) for i, m in marks)) - 32 > most:
                return most + 1
        eq = where.get(c, 0)
        x = eq | down
        d = (((eq & up) + up & full) ^ up) | eq
        plus = down | (full ^ (d | up))
        minus = up & d
        if plus & top:
            room -= 2
            if room < 0:
                return most + 1
        elif not minus & top:
            room -= 1
            if room < 0:
                return most + 1
        plus = (plus << 1 | 1) & full
        down = plus & x
        up = (minus << 1 & full) | (full ^ (x | plus))
    return most - room


LETTERS, PAIRS = 64, 192


def sketches(texts: np.ndarray) -> np.ndarray:
    """Counts of each text's characters and of its pairs of characters, in LETTERS and PAIRS bins."""
    out = np.zeros((len(texts), LETTERS + PAIRS), np.uint16)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    part = np.cumsum(lengths) >> 20
    for p in np.unique(part).tolist():
        a, b = np.searchsorted(part, p), np.searchsorted(part, p, "right")
        code = np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(b - a), lengths[a:b])
        bins = row * (LETTERS + PAIRS)
        count = np.bincount(bins + (code & (LETTERS - 1)), minlength=(b - a) * (LETTERS + PAIRS))
        two = (code[:-1] * np.uint32(131) + code[1:]) % np.uint32(PAIRS)
        inside = row[:-1] == row[1:]
        count += np.bincount(bins[:-1][inside] + LETTERS + two[inside], minlength=len(count))
        out[a:b] = np.minimum(count, 65535).reshape(b - a, -1)
    return out


def may_be_similar(part: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether lengths and sketches leave it open that texts are similar: an edit adds a character, takes
    one or both, and so adds and takes at most two pairs. Texts of LENGTHY characters or more also need
    SimHashes within NEAR bits."""
    a, b = part["size"][i].astype(np.int64), part["size"][j].astype(np.int64)
    longer = np.maximum(a, b)
    most = ((1 - MIN_SIMILARITY) * longer + 1e-9).astype(np.int64)
    found = (np.abs(a - b) <= most) & ((longer < LENGTHY) | (np.bitwise_count(part["fp"][i] ^ part["fp"][j]) <= NEAR))
    at = np.flatnonzero(found)
    for s in range(0, len(at), 4096):
        own = at[s : s + 4096]
        for bins, each in ((slice(LETTERS), 1), (slice(LETTERS, None), 2)):
            d = part["sketch"][i[own], bins].astype(np.int32) - part["sketch"][j[own], bins]
            more = np.maximum(d, 0).sum(axis=1)
            ok = np.maximum(more, more - d.sum(axis=1)) <= each * most[own]
            ok |= longer[own] >= 65535  # counts that don't fit 16 bits
            found[own] &= ok
            own = own[ok]
    return found


def surely_within(a: str, b: str, most: int, window: int = 10) -> bool:
    """Whether a plain alignment of words already costs at most ``most``: where words differ, it goes on
    at the nearest place where two words in a row are equal, and counts the longer side in between. It
    is an edit script, so True is certain; False says nothing."""
    x, y = a.split(" "), b.split(" ")
    n, m = len(x), len(y)
    i = j = cost = 0
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in _MEETINGS[window]:
            u, v = i + p, j + q
            if u < n and v < m and x[u] == y[v] and (x[u + 1 : u + 2] == y[v + 1 : v + 2]):
                break
        else:
            break
        cost += max(sum(map(len, x[i:u])) + p, sum(map(len, y[j:v])) + q)
        if cost > most:
            return False
        i, j = u, v
    return cost + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j) <= most


_MEETINGS = {10: [(p, s - p) for s in range(1, 11) for p in sorted(range(s + 1), key=lambda p: abs(2 * p - s))]}


def similar(a: str, b: str, least: float = MIN_SIMILARITY) -> bool:
    """1 - distance / longer length is at least ``least``."""
    longer = max(len(a), len(b))
    if abs(len(a) - len(b)) > (1 - least) * longer + 1e-9:
        return False
    most = int((1 - least) * longer + 1e-9)
    return surely_within(a, b, most) or edit_distance(a, b, most) <= most


#: So many pairs for each block of rows are worth comparing side by side; their tables take up to so many bytes.
FEW, TABLE_BYTES = 24, 16 << 20


_STRIDES = (256, 64, 16, 4, 1)  #: of the search for where two texts begin to differ


def edit_distances(firsts: str | list[str], seconds: list[str], most: np.ndarray) -> np.ndarray:
    """edit_distance of many pairs, side by side: Myers' bit vectors in blocks of 64 rows of the shorter text,
    a lane for each pair. Lanes that are sure to exceed their ``most`` are given up. One text as ``firsts``
    goes with all of ``seconds``."""
    firsts = [firsts] * len(seconds) if isinstance(firsts, str) else firsts
    out = np.asarray(most, np.int64) + 1
    rows: list[str] = []
    texts: list[str] = []
    own = []
    for k, (a, b) in enumerate(zip(firsts, seconds)):
        low, high, short = 0, 0, min(len(a), len(b))
        for n in _STRIDES:
            while low + n <= short and a[low : low + n] == b[low : low + n]:
                low += n
        end, other = len(a), len(b)
        for n in _STRIDES:
            while low + high + n <= short and a[end - high - n : end - high] == b[other - high - n : other - high]:
                high += n
        if short == low + high:
            out[k] = max(len(a), len(b)) - short
        elif abs(len(a) - len(b)) < out[k]:
            a, b = a[low : len(a) - high], b[low : len(b) - high]
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            rows.append(a)
            texts.append(b)
            own.append(k)
    at = np.array(own, np.int64)
    blocks = -(-np.fromiter(map(len, rows), np.int64, len(rows)) // 64)
    for n in np.unique(blocks).tolist():
        lanes = np.flatnonzero(blocks == n)
        if len(lanes) < FEW * n:
            for i in lanes.tolist():
                out[at[i]] = edit_distance(rows[i], texts[i], int(out[at[i]]) - 1)
            continue
        alphabet = np.unique(np.frombuffer("".join([rows[i] for i in lanes.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32))
        step = max(FEW * n, TABLE_BYTES // (8 * n * (len(alphabet) + 1)))
        lanes = lanes[np.argsort([-len(texts[i]) for i in lanes.tolist()], kind="stable")]  # those that go on are the first ones
        for s in range(0, len(lanes), step):
            some = lanes[s : s + step]
            out[at[some]] = _side_by_side([rows[i] for i in some.tolist()], [texts[i] for i in some.tolist()], out[at[some]] - 1, n, alphabet)
    return out


def _codes(texts: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, a row for each place and a column for each text of places in alphabet; its length: none)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.minimum(np.searchsorted(alphabet, raw), len(alphabet) - 1)
    found[alphabet[found] != raw] = len(alphabet)
    out = np.full((int(sizes.max()), len(texts)), len(alphabet), np.int64)
    out[np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(len(texts)), sizes)] = found
    return sizes, out


def _side_by_side(rows: list[str], texts: list[str], limit: np.ndarray, blocks: int, alphabet: np.ndarray) -> np.ndarray:
    """edit_distances of texts, longest first, whose ``rows`` all fill so many blocks; ``alphabet``: of the rows."""
    n = len(rows)
    out = limit + 1
    height, code = _codes(rows, alphabet)
    lane = np.arange(n)
    eq = np.zeros((blocks, len(alphabet) + 1, n), np.uint64)
    for i in range(len(code)):
        there = lane if i < height.min() else np.flatnonzero(height > i)
        eq[i // 64, code[i, there], there] |= np.uint64(1 << i % 64)
    eq = eq.reshape(blocks, -1)
    size, text = _codes(texts, alphabet)
    text = text * n + lane
    score, top = height.copy(), ((height - 1) % 64).astype(np.uint64)
    up = [np.full(n, ~np.uint64(0)) for _ in range(blocks)]
    down = [np.zeros(n, np.uint64) for _ in range(blocks)]
    one, high = np.uint64(1), np.uint64(63)
    with np.errstate(over="ignore"):
        for t in range(len(text) + 1):
            if t % 16 == 0 or t == len(text) or size[-1] == t:
                done = size == t
                out[lane[done]] = score[done]
                go = ~done & (score - (size - t) <= limit)
                if t % 16 == 0:
                    go &= _least(up, down, t, height, size) <= limit
                if not go.all():
                    lane, size, limit, score, top, height, text = lane[go], size[go], limit[go], score[go], top[go], height[go], text[:, go]
                    up, down = [x[go] for x in up], [x[go] for x in down]
                if not len(lane):
                    break
            now = text[t]
            plus = minus = None
            for w in range(blocks):
                e, p, m = eq[w].take(now), up[w], down[w]
                x = e | m
                if w:
                    e |= minus
                h = e & p
                h += p
                h ^= p
                h |= e
                less = p & h
                h |= p
                more = m | ~h
                if w == blocks - 1:
                    score += ((more >> top) & one).view(np.int64)
                    score -= ((less >> top) & one).view(np.int64)
                shifted, fewer = more << one, less << one
                shifted |= plus if w else one
                if w:
                    fewer |= minus
                plus, minus = more >> high, less >> high
                down[w] = shifted & x
                x |= shifted
                fewer |= ~x
                up[w] = fewer
    return out


def _least(up: list[np.ndarray], down: list[np.ndarray], t: int, height: np.ndarray, size: np.ndarray) -> np.ndarray:
    """No more than what each lane's distance can still become after t columns: the way there leaves
    column t at some row, which is at most 4 off one of every 8th row."""
    off = height - (size - t)
    out, at = t + np.abs(off), np.full(len(off), t)
    for w, (p, m) in enumerate(zip(up, down)):
        steps = np.bitwise_count(p.view(np.uint8)).astype(np.int64) - np.bitwise_count(m.view(np.uint8))
        for i, step in enumerate(steps.reshape(-1, 8).T):
            at = at + step
            np.minimum(out, at + np.abs(off - (64 * w + 8 * i + 8)), out=out)
    return out - 8


def within(firsts: list[str], seconds: list[str], least: float = MIN_SIMILARITY) -> np.ndarray:
    """similar, of many pairs, without a try of surely_within."""
    longer = np.array([max(len(a), len(b)) for a, b in zip(firsts, seconds)], np.int64)
    most = ((1 - least) * longer + 1e-9).astype(np.int64)
    return edit_distances(firsts, seconds, most) <= most


def surely_similar(a: str, b: str) -> bool | None:
    """similar, where that is soon seen, else None."""
    most = int((1 - MIN_SIMILARITY) * max(len(a), len(b)) + 1e-9)
    return False if abs(len(a) - len(b)) > most else surely_within(a, b, most) or None


def similar_to(a: str, texts: list[str], least: float = MIN_SIMILARITY) -> np.ndarray:
    """similar, of one text and many."""
    return within([a] * len(texts), texts, least)


def normalised(line: bytes) -> str:
    """The words of a line with one space between them, in lower case."""
    return b" ".join(line.translate(FOLD.tobytes()).split()).decode("utf-8", "replace")


class Lines:
    """Lines of some texts, cut at line feeds; those with a word take part (``own``)."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        breaks = np.flatnonzero(self.data == 10) + 1
        bounds = np.concatenate((self.offsets, breaks))
        bounds.sort(kind="stable")
        self.bounds = bounds[np.concatenate(([True], bounds[1:] != bounds[:-1]))]  # also where empty texts meet
        self.text = np.searchsorted(self.offsets, self.bounds[:-1], "right") - 1
        self._words = words(self.data, self.bounds)
        cut = np.searchsorted(self._words.segment, np.arange(len(self.bounds)))
        self.number = np.arange(len(self.text)) - np.searchsorted(self.text, self.text)  #: of each line in its text
        self.own = np.flatnonzero(np.diff(cut))
        self._from, self._to = cut[self.own], cut[self.own + 1]
        self.key = sequence_hash(self._words.hashes, cut)[self.own].view(np.int64) if len(self.own) else np.zeros(0, np.int64)

    def sizes(self) -> np.ndarray:
        """Code points of each normalised line."""
        w = self._words
        upto = np.concatenate(([0], np.cumsum(w.ends - w.starts + 1)))
        going = np.flatnonzero((self.data & 0xC0) == 0x80)  # bytes that begin no code point, all in words
        more = np.searchsorted(going, self.bounds)
        return upto[self._to] - upto[self._from] - 1 - (more[self.own + 1] - more[self.own])

    def units(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, bounds, spelt) of the units of some own lines: words, or the characters of lines of few
        words, which are spelt."""
        w = self._words
        first, last = self._from[some], self._to[some]
        few = last - first < WORDY
        count = np.where(few, 0, last - first)
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        line = np.repeat(np.arange(len(some)), count)
        hashes = w.hashes[at]
        if few.any():
            long = (last - first)[few]
            small = np.repeat(first[few] - (np.cumsum(long) - long), long) + np.arange(long.sum())
            size = w.ends[small] - w.starts[small]
            place = np.repeat(w.starts[small] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            owner = np.repeat(np.repeat(np.flatnonzero(few), long), size)
            begins = (self.data[place] & 0xC0) != 0x80
            place, owner = place[begins], owner[begins]
            code = FOLD[self.data[place]].astype(np.uint64)
            going = np.ones(len(place), bool)
            for i in range(1, 4):
                byte = self.data[np.minimum(place + i, len(self.data) - 1)]
                going &= ((byte & 0xC0) == 0x80) & (place + i < len(self.data))
                code |= np.where(going, byte, 0).astype(np.uint64) << np.uint64(8 * i)
            line = np.concatenate((line, owner))
            hashes = np.concatenate((hashes, mix(code + np.uint64(1))))
            order = np.argsort(line, kind="stable")
            line, hashes = line[order], hashes[order]
        return hashes, np.searchsorted(line, np.arange(len(some) + 1)), few


def simhashes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SimHashes over pairs of neighbouring units, so that frequent words alone make no lines alike; a
    line's last unit stands alone."""
    if not len(hashes):
        return np.zeros(len(bounds) - 1, np.uint64)
    after = np.append(hashes[1:], np.uint64(0))
    ends = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    after[ends] = 0
    with np.errstate(over="ignore"):
        return majority_bits(mix(hashes * np.uint64(3) + after), bounds)


def _level(n: np.ndarray) -> np.ndarray:
    """The power of two of which 4 to 7 go into n."""
    return 1 << np.maximum(np.floor(np.log2(np.maximum(n, 4))).astype(np.int64) - 2, 0)


def block_keys(hashes: np.ndarray, bounds: np.ndarray, spelt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): blocks of each line's n units, of which lines that are alike share one if
    - n is below LONG, both have n units, and these differ in at most two quarters (two make a key);
    - n is below LONG, and they differ in one stretch, which may have more units in one of them (first
      and last halves, of all lengths that a partner's half may have);
    - n is larger, and the edits leave one of 4 to 7 blocks, counted from the start or from the end.
    Lines of fewer than four units are alike only if they are equal."""
    n = np.diff(bounds)
    sums = range_sums(hashes)
    lines, keys = [], []
    long_from = np.where(spelt, LONG_SPELT, LONG)

    def add(which, value, tag):
        with np.errstate(over="ignore"):
            lines.append(which)
            keys.append(mix(value + np.asarray(tag).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))

    short = np.flatnonzero((n >= 4) & (n < long_from))
    if len(short):
        cuts = [bounds[short] + n[short] * i // 4 for i in range(5)]
        quarter = [range_hash(sums, cuts[i], cuts[i + 1]) for i in range(4)]
        for i in range(4):
            for j in range(i + 1, 4):
                with np.errstate(over="ignore"):
                    add(short, mix(quarter[i]) * np.uint64(3) + quarter[j], 1000 * n[short] + 4 * i + j)
    halved = np.flatnonzero((n >= 4) & (n * MIN_SIMILARITY < long_from))
    least = np.minimum(np.ceil(n[halved] * MIN_SIMILARITY / 2).astype(np.int64), np.maximum((n[halved] - 1) // 2, 2))
    count = n[halved] // 2 - least + 1
    line = np.repeat(halved, count)
    half = np.repeat(least - (np.cumsum(count) - count), count) + np.arange(count.sum())
    add(line, range_hash(sums, bounds[line], bounds[line] + half), 100_000 + half)
    add(line, range_hash(sums, bounds[line + 1] - half, bounds[line + 1]), 200_000 + half)
    long = np.flatnonzero(n >= long_from)
    own, below = _level(n[long]), _level(np.ceil(MIN_SIMILARITY * n[long]).astype(np.int64))
    for which, width in ((long, own), (long[below != own], below[below != own])):
        count = n[which] // width
        line = np.repeat(which, count)
        w = np.repeat(width, count)
        i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        add(line, range_hash(sums, bounds[line] + i * w, bounds[line] + (i + 1) * w), 300_000 + 64 * w + 2 * i)
        add(line, range_hash(sums, bounds[line + 1] - (i + 1) * w, bounds[line + 1] - i * w), 300_000 + 64 * w + 2 * i + 1)
    if not lines:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(lines), np.concatenate(keys)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text"))


def _line_rows(piece: pa.RecordBatch, lines: Lines, sizes: np.ndarray) -> pa.RecordBatch:
    """A row for each line that takes part."""
    rows = pa.array(lines.text[lines.own])
    return pa.RecordBatch.from_arrays(
        [piece.column(0).take(rows), piece.column(1).take(rows), pa.array(lines.number[lines.own], pa.int32()), pa.array(lines.key), pa.array(sizes, pa.int32())],
        names=["doc_id", "th", "line", "key", "size"],
    )


_STEPS = 3000  # sizes travel as logarithms in 16 bits


def _fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a.astype(np.int64) - b.astype(np.int64)) <= -np.log(MIN_SIMILARITY) * _STEPS + 2


def candidates(docs: DataFrame, rows: int) -> DataFrame:
    """Rows of two kinds. (grp, id): sets of different normalised lines that share a block of words, or are
    linked by SimHashes within DISTANCE bits in a shared block of bits; a line's id is the hash of its normal
    form. Rows without grp: every line's (doc_id, th, line, key, size), so that texts are read and cut once.

    Entries travel as arrays to as many targets as there are tasks, or more, so that each has some 16 MB,
    and a task holds one target at a time; a slice's lines go along in one piece. Sets with the same members have one number,
    so lines that share many blocks meet once in what follows. A target of more than HOT_BYTES (a block that very many
    different lines share) isn't held: its entries are given on as they are, a set for each block."""
    spark = docs.sparkSession
    n = partitions(spark)
    targets = n * max(1, 4 * rows * ENTRY_BYTES // (HOT_BYTES * n))  # some 16 MB each
    masks = exact_masks(DISTANCE, rows)
    table = np.array(masks, np.uint64)
    names = ["t", "key", "id", "size", "fp"]

    def entries(batches):
        seen: set[int] = set()
        packed: list[tuple[int, bytes]] = []  # lines, as record batches in bytes

        def pieces():
            for whole in batches:
                for piece in sliced(whole, "text", SLICE):
                    lines = Lines(piece.column(2))
                    sizes = lines.sizes()
                    if len(lines.own):
                        packed.append((2 * targets + int(lines.key[0] & 0xFFFFF), _packed(_line_rows(piece, lines, sizes))))
                    _, first = np.unique(lines.key, return_index=True)
                    first = first[[k not in seen for k in lines.key[first].tolist()]] if len(first) else first
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.update(lines.key[first].tolist())
                    if not len(first):
                        continue
                    hashes, bounds, spelt = lines.units(first)
                    ids = lines.key[first].view(np.uint64)
                    size = np.minimum(np.log(sizes[first]) * _STEPS, 65535).astype("<u2")
                    line, key = block_keys(hashes, bounds, spelt)
                    part = (key % np.uint64(targets)).astype(np.int64) * 2
                    yield part, [(key >> np.uint64(32)).astype("<u4"), ids[line], size[line], np.zeros((len(line), 0), "<u8")]
                    fps = simhashes(hashes, bounds)
                    for tab, mask in enumerate(table):
                        key = mix((fps & mask) + np.uint64(tab))
                        part = (key % np.uint64(targets)).astype(np.int64) * 2 + 1
                        yield part, [np.full(len(fps), tab, "<u4"), ids, size, fps]

        def given():
            none = [b""] * len(packed)
            if packed:
                t, raw = zip(*packed)
                packed.clear()
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), *(pa.array(c, pa.binary()) for c in (raw, none, none, none))], names=names)

        for batch in _two_kinds(pieces(), names):
            yield batch
            yield from given()
        yield from given()
        blobs.give_back()

    kinds = ["<u4", "<u8", "<u2", "<u8"]

    def sets_of(target: int, parts: list) -> tuple[np.ndarray, np.ndarray]:
        key, ids, size, fps = blobs.read(parts, kinds)
        if target % 2:
            by = np.lexsort((ids, key))
            by = by[np.concatenate(([True], (key[by][1:] != key[by][:-1]) | (ids[by][1:] != ids[by][:-1])))]
            key, ids, size, fps = key[by], ids[by], size[by], fps[by]
            links = many_buckets(mix((fps & table[key]) + key.astype(np.uint64)).view(np.int64), fps, key, masks, DISTANCE, _fit, size)
            return _linked(links, ids)
        both = (key.astype(np.uint64) << np.uint64(32)) | (ids >> np.uint64(32))
        by = np.argsort(both)
        key, ids, size = key[by], ids[by], size[by]
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])))
        key, ids, size = key[once], ids[once], size[once]
        more = np.zeros(len(key), bool)  # most blocks have one line
        more[1:] = key[1:] == key[:-1]
        more[:-1] |= more[1:]
        key, ids, size = key[more], ids[more], size[more]
        if not len(key):
            return _numbered(key, ids)
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        # a member stays if the next smaller or larger one of its block fits
        by = np.lexsort((size, group))
        g, s = group[by], size[by]
        fit = (g[1:] == g[:-1]) & _fit(s[1:], s[:-1])
        stay = np.zeros(len(by), bool)
        stay[1:] |= fit
        stay[:-1] |= fit
        own = np.sort(by[stay])
        return _numbered(group[own], ids[own])

    found = ["grp", "id", "doc_id", "th", "line", "key", "size"]

    def gather(batches):
        for target, parts, whole in blobs.runs(batches, HOT_BYTES):
            if target >= 2 * targets:
                for raw in (raw for part in parts for raw in part.column(1)):
                    line = pa.ipc.open_stream(raw.as_buffer()).read_next_batch()
                    none = pa.nulls(line.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, *line.columns], names=found)
                continue
            if not whole:
                for part in parts:
                    key, ids, size, fps = blobs.read([part], kinds)
                    key = mix((fps & table[key]) + key.astype(np.uint64)) if target % 2 else mix(key.astype(np.uint64) + (np.uint64(target) << np.uint64(32)))
                    yield _pairs(key, ids)
                continue
            grp, ids = sets_of(target, parts)
            if len(ids):
                yield _pairs(grp, ids)
        blobs.give_back()

    sent = _source(docs).mapInArrow(entries, "t int, key binary, id binary, size binary, fp binary")
    return sent.repartition(n, "t").sortWithinPartitions("t").mapInArrow(gather, "grp long, id long, doc_id long, th long, line int, key long, size int")


def _two_kinds(pieces, names):
    """flushing, with entries of both kinds held apart: arrays of one kind have no fingerprints."""
    held: list[list] = [[], []]
    size = 0
    for target, arrays in pieces:
        held[int(arrays[3].ndim == 1)].append((target, arrays))
        size += sum(a.nbytes for a in arrays)
        if size >= 16 << 20:
            for one in held:
                yield from blobs.flushing(one, names, 1 << 62)
            held, size = [[], []], 0
    for one in held:
        yield from blobs.flushing(one, names, 1 << 62)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pairs(grp: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(ids), pa.int64())
    small = pa.nulls(len(ids), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(grp.view(np.int64)), pa.array(ids.view(np.int64)), none, none, small, none, small], names=["grp", "id", "doc_id", "th", "line", "key", "size"])


def _numbered(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, id) of the groups' members, once each; a group's number is a hash of its members."""
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    with np.errstate(over="ignore"):
        number = mix(np.add.reduceat(mix(ids), edges))
    number = np.repeat(number, np.diff(np.append(edges, len(ids))))
    by = np.lexsort((ids, number))
    number, ids = number[by], ids[by]
    once = np.concatenate(([True], (number[1:] != number[:-1]) | (ids[1:] != ids[:-1])))
    return number[once], ids[once]


def _linked(links: list[tuple[int, int]], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The connected sets of some links between rows."""
    if not links:
        return _numbered(np.zeros(0, np.int64), np.zeros(0, np.uint64))
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        root[find(i)] = find(j)
    member = np.array(sorted(root, key=lambda i: (find(i), ids[i])), np.int64)
    return _numbered(np.array([find(i) for i in member.tolist()]), ids[member])


SAMPLE = 4096  #: texts whose lines are counted


def _about_rows(docs: DataFrame) -> int:
    """About how many lines docs have: as many a text as the first SAMPLE ones. It sets how finely work is
    dealt out; what is found doesn't depend on it."""
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    some = [r[0] or 0 for r in docs.select(breaks + F.lit(1)).take(SAMPLE)]
    return docs.count() * sum(some) // max(1, len(some))


def line_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, groups): every line's (doc_id, th, line, key, size), th a hash of its text; and key,
    component for the keys that are linked to another one."""
    lines, _, groups = _line_groups(docs)
    return lines, groups


def _line_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """line_groups, and between its tables: each key, at (the first line that has it) and n, their number.

    Normalised lines are told apart by a 64-bit hash. Lines that have a candidate partner fetch their
    text, once each, and edit similarity decides."""
    found, _ = materialize(candidates(docs, _about_rows(docs)), "found")
    lines = found.where("grp is null").select("doc_id", "th", "line", "key", "size")
    met, _ = materialize(found.where("grp is not null").select("grp", "id").distinct(), "met")
    firsts = lines.groupBy("key").agg(F.min(F.struct("doc_id", "th", "line")).alias("at"), F.first("size").alias("size"), F.count("*").alias("n"))
    firsts, _ = materialize(firsts, "firsts")
    wanted = firsts.join(met.select(F.col("id").alias("key")).distinct(), "key", "left_semi").select("at.doc_id", "at.th", "at.line", "key", "size")
    texts, _ = materialize(_fetch(docs, wanted), "texts")
    keyed = met.join(texts, met.id == texts.key).select(F.col("grp").alias("key"), "fp", "id", "size", "text")
    return lines, firsts, connected_components(bucket_links(keyed, 64, surely_similar, chunk=512, fits=may_be_similar, sketch=sketches, decide=within))


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, size, SimHash and the normalised text of the wanted lines. Of rows repeated as a whole a task gives
    them once; where such rows are split between tasks a line may come again, and be linked to itself."""
    grouped = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("line", "key", "size")).alias("lines"))
    marked = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    joined = marked.join(grouped.hint("shuffle_hash"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))).select("text", "lines")

    def run(batches):
        seen: set[int] = set()
        for whole in batches:
            for piece in sliced(whole, "text", SLICE):
                out = []
                for text, own in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    cut = text.split(b"\n")
                    for x in own:
                        if x["key"] not in seen:
                            seen.add(x["key"])
                            out.append((x["key"], x["size"], normalised(cut[x["line"]])))
                if out:
                    key, size, line = (pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.string())))
                    taken = Lines(line)
                    fps = simhashes(*taken.units(np.arange(len(taken.own)))[:2]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([key, size, pa.array(fps), line], names=["key", "size", "fp", "text"])
        blobs.give_back()

    return joined.mapInArrow(run, "key long, size int, fp long, text string")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the text's repeated lines taken out, and n_lines, n_dropped.

    Of each connected group of lines (equal in their words, or alike) the first by (doc_id, text hash,
    line) stays, whatever their length; of rows equal in doc_id and text one keeps it. Lines without a
    letter or digit stay. Null texts stay null and have no lines, an empty text has one; an empty table
    gives no rows. Columns named n_lines or n_dropped are replaced, all others pass through."""
    lines, firsts, groups = _line_groups(docs)
    # lines that no other one equals or is like stay and go no further
    several, _ = materialize(firsts.select("key", "at", "n").join(groups.withColumnRenamed("node", "key"), "key", "left").where("n > 1 or component is not null"), "several")
    best = several.where("component is not null").groupBy("component").agg(F.min("at").alias("best"))
    first = several.join(best, "component", "left").select("key", F.coalesce("best", "at").alias("at"))
    is_first = F.struct("doc_id", "th", "line").eqNullSafe(F.col("at"))
    own = lines.join(first, "key").select("doc_id", "th", "line", F.when(is_first, F.col("line")).alias("kept"))
    both = own.groupBy("doc_id", "th").agg(F.collect_set("line").alias("all"), F.collect_set("kept").alias("kept"), F.count("kept").alias("n"))
    # of rows repeated as a whole all lines are here, and those that are kept more than once
    drops = both.select("doc_id", "th", "all", F.array_except("all", "kept").alias("gone"), (F.col("n") > F.size("kept")).alias("again")).where("size(gone) > 0 or again")
    drops, _ = materialize(drops, "drops")
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    d, t, h, gone, every, again, copy = unused(others, "d", "t", "h", "gone", "all", "again", "copy")
    drops = drops.select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("gone").alias(gone), F.col("all").alias(every), F.col("again").alias(again))
    marked = docs.select(*(F.col(f"`{c}`") for c in others), F.xxhash64("text").alias(h))
    joined = marked.join(drops.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), "left")
    if not drops.where(F.col(again)).isEmpty():  # rows repeated as a whole: the first one has the lines
        order = Window.partitionBy("doc_id", h).orderBy(F.lit(0))
        joined = joined.withColumn(copy, F.when(F.col(again), F.row_number().over(order)).otherwise(1))
        joined = joined.withColumn(gone, F.when(F.col(copy) > 1, F.col(every)).otherwise(F.col(gone)))
    source = joined.select(*(F.col(f"`{c}`") for c in others), F.col(gone))
    schema = source.drop(gone).schema.add("n_lines", "long", False).add("n_dropped", "long", False)
    place = others.index("text")

    def run(batches):
        for whole in batches:
            for piece in sliced(whole, "text", 4 << 20):
                texts, gone = piece.column(place), piece.column(len(others))
                n_lines = pc.fill_null(pc.add(pc.count_substring(texts, "\n"), 1), 0).cast(pa.int64())
                n_dropped = pc.fill_null(pc.list_value_length(gone), 0).cast(pa.int64())
                changed = np.flatnonzero(n_dropped.to_numpy(zero_copy_only=False))
                if len(changed):
                    out = texts.to_pylist()
                    for i, own in zip(changed.tolist(), gone.take(pa.array(changed)).to_pylist()):
                        own = set(own)
                        out[i] = "\n".join([x for j, x in enumerate(out[i].split("\n")) if j not in own])
                    texts = pa.array(out, texts.type)
                columns = [texts if i == place else c for i, c in enumerate(piece.columns[:-1])]
                yield pa.RecordBatch.from_arrays([*columns, n_lines, n_dropped], names=[*others, "n_lines", "n_dropped"])
        blobs.give_back()

    return source.mapInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs in their own columns, with n_chars set anew; a text of which no word is left goes."""
    found = dedup_lines(docs).where((F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: their lines, the lines dropped, and a digest of what stays. Null text: no line, and
    the digest of nothing; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
