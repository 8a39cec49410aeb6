"""Benchmark decontamination by spaced seeds, with substitution-tolerant verification.

Seeds of documents and of benchmark items are hashed and joined, partitioned on both sides; a bitmap of
fixed size, of the benchmark's seeds, keeps most seeds of documents out of the shuffle. The diagonals that
hits name are then verified on the words themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import give_back
from .common import materialize, sliced, text_bytes, unused
from .textkernel import mix, sequence_hash, words

#: Token positions that a seed compares; the others may differ. Every run with MIN_WORDS equal words, at
#: least MIN_SIMILARITY of it equal, holds one of these seeds, wherever the others are.
MASKS = ("11111", "111011")
MIN_WORDS = 13
MIN_SIMILARITY = 0.8
#: The bitmap has a bit for each value of so many leading bits of a seed's hash: 4 MB, whatever the benchmark's size.
BITS = 25


def needed(n: int) -> int:
    """Equal words that an item of ``n`` words asks for."""
    return min(MIN_WORDS, int(np.ceil(MIN_SIMILARITY * n)))


def masks_of(n: int) -> tuple[str, ...]:
    """The seeds of an item of ``n`` words. If it asks for less than MIN_WORDS, the longest stretch that
    its equal words are sure to make: k others cut them into k + 1."""
    if needed(n) == MIN_WORDS:
        return MASKS
    return ("1" * -(-needed(n) // (n - needed(n) + 1)),)


def _mask_hash(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed's hash at every start; as long as ``hashes``, with wrong values in the last places."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i, on in enumerate(mask):
            if on == "1":
                out[: n - i] = (out[: n - i] ^ hashes[i:]) * np.uint64(0x9E3779B97F4A7C15)
        return mix(out + np.uint64(len(mask)))


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the first run with the most equal words among all runs that have at
    least MIN_SIMILARITY of them; it starts and ends with an equal word."""
    worth = np.where(same, 1, -round(MIN_SIMILARITY / (1 - MIN_SIMILARITY)))
    score = np.concatenate(([0], np.cumsum(worth)))  # a run is similar if its end has no lower score than its start
    first = np.searchsorted(-np.minimum.accumulate(score), -score, "left")  # the earliest start for each end
    count = np.concatenate(([0], np.cumsum(same)))
    matched = count - count[first]
    end = int(np.argmax(matched))
    if not matched[end]:
        return 0, 0, 0
    start = int(first[end])
    return start + int(np.argmax(same[start:end])), end, int(matched[end])


def entries(benchmark: DataFrame) -> DataFrame:
    """entry, item_ids, words, n: items with the same words are one entry, named by a hash of them. Items
    without a word, and null ones, are left out."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")

    def run(batches):
        for whole in batches:
            for piece in sliced(whole, "text"):
                data, offsets = text_bytes(piece.column(1))
                found = words(data, offsets)
                bounds = np.searchsorted(found.segment, np.arange(piece.num_rows + 1))
                some = np.flatnonzero(np.diff(bounds))
                if len(some):
                    key = sequence_hash(found.hashes, bounds)[some].view(np.int64)
                    raw = [found.hashes[bounds[i] : bounds[i + 1]].tobytes() for i in some.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(key), piece.column(0).take(pa.array(some)), pa.array(raw, pa.binary())], names=["entry", "item_id", "words"])

    hashed = items.mapInArrow(run, "entry long, item_id long, words binary")
    return hashed.groupBy("entry").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.first("words").alias("words")).withColumn("n", F.octet_length("words") / 8)


def seeds(found: DataFrame) -> DataFrame:
    """seed, entry, place: a row for each seed of each entry."""

    def run(batches):
        for batch in batches:
            out = []
            for entry, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw, np.uint64)
                for mask in masks_of(len(own)):
                    h = _mask_hash(own, mask)[: len(own) - len(mask) + 1]
                    out.append((h, np.full(len(h), entry), np.arange(len(h))))
            if out:
                h, entry, place = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(entry, pa.int64()), pa.array(place, pa.int32())], names=["seed", "entry", "place"])

    return found.select("entry", "words").mapInArrow(run, "seed long, entry long, place int").distinct()


def bitmap(found: DataFrame) -> np.ndarray:
    """A bit for each value of the leading BITS bits of a seed: 2**BITS / 8 bytes come to the driver."""
    at = F.shiftrightunsigned("seed", 64 - BITS) + 1  # these functions count from one
    parts = found.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in parts.toLocalIterator():
        raw = np.frombuffer(r["bits"], np.uint8)
        begin = (r["part"] - 1) * len(raw)
        out[begin : begin + len(raw)] = raw
    return out


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text"))


def hits(docs: DataFrame, masks: list[str], bits: np.ndarray) -> DataFrame:
    """doc_id, th, seed, at: the seeds of all texts whose bit is set, with their first word."""
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches):
        known = np.frombuffer(shared.value, np.uint8)
        for whole in batches:
            for piece in sliced(whole, "text"):
                data, offsets = text_bytes(piece.column(2))
                found = words(data, offsets)
                bounds = np.searchsorted(found.segment, np.arange(piece.num_rows + 1))
                for mask in masks:
                    h = _mask_hash(found.hashes, mask)[: max(len(found.hashes) - len(mask) + 1, 0)]
                    lead = (h >> np.uint64(64 - BITS)).astype(np.int64)
                    at = np.flatnonzero(known[lead >> 3] >> (lead & 7).astype(np.uint8) & 1)
                    at = at[found.segment[at] == found.segment[at + len(mask) - 1]]
                    if len(at):
                        row = found.segment[at]
                        rows = pa.array(row)
                        yield pa.RecordBatch.from_arrays(
                            [piece.column(0).take(rows), piece.column(1).take(rows), pa.array(h[at].view(np.int64)), pa.array(at - bounds[row], pa.int32())], names=["doc_id", "th", "seed", "at"]
                        )
        give_back()

    return _marked(docs).mapInArrow(run, "doc_id long, th long, seed long, at int")


def longest(text: np.ndarray, entry: np.ndarray, diagonals: list[int]) -> tuple[int, int, int]:
    """(first word, words, equal words) of the best run on any of the diagonals; of equal ones the first
    in the text. Zeros if none is similar enough."""
    best = (0, 0, 0)
    for d in sorted(diagonals):
        a, b = max(d, 0), min(d + len(entry), len(text))
        same = text[a:b] == entry[a - d : b - d]
        if np.count_nonzero(same) >= max(needed(len(entry)), best[2] + 1):
            start, end, matched = best_run(same)
            if matched >= needed(len(entry)) and matched > best[2]:
                best = (a + start, end - start, matched)
    return best


_FOUND = "doc_id long, th long, item_ids array<long>, start_word long, n_words long, n_matched long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document (doc_id, text): doc_id, th (a hash of the text), all item_ids found
    in it, and the place, length and equal words of the longest overlap (of equal ones that of the item
    with the smallest id, and the first in the text).

    A text is contaminated by an item if on one diagonal a run of words, at least MIN_SIMILARITY of them
    equal, has MIN_WORDS equal words, or MIN_SIMILARITY of the item's words if that is fewer. Words are
    compared without ASCII case and punctuation. Hits come from seeds with masked positions, of which
    every such run holds one; inserted words split an overlap in two. Null texts are empty, null doc_ids
    are told apart by their texts, rows equal in both are one; an empty benchmark finds nothing."""
    spark = docs.sparkSession
    known, _ = materialize(entries(benchmark), "entries")
    lengths = [r[0] for r in known.select(F.least("n", F.lit(4 * MIN_WORDS)).cast("int")).distinct().collect()]  # so few values
    masks = sorted({m for n in lengths for m in masks_of(n)})
    if not masks:
        return spark.createDataFrame([], _FOUND)
    table, _ = materialize(seeds(known), "seeds")
    met = hits(docs, masks, bitmap(table)).join(table, "seed")
    named = met.groupBy("doc_id", "th", "entry").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals"))
    tried = named.join(known, "entry").groupBy("doc_id", "th").agg(F.collect_list(F.struct("item_ids", "words", "diagonals")).alias("tries"))
    tried, _ = materialize(tried, "tries")
    tried = tried.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "tries")
    source = _marked(docs).join(tried, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("doc_id", "th", "text", "tries")

    def run(batches):
        for whole in batches:
            for piece in sliced(whole, "text"):
                data, offsets = text_bytes(piece.column(2))
                found = words(data, offsets)
                bounds = np.searchsorted(found.segment, np.arange(piece.num_rows + 1))
                rows = []
                for i in range(piece.num_rows):
                    own, ids, best = found.hashes[bounds[i] : bounds[i + 1]], set(), None
                    for x in piece.column(3)[i].as_py():
                        start, n, matched = longest(own, np.frombuffer(x["words"], np.uint64), x["diagonals"])
                        if matched:
                            ids.update(x["item_ids"])
                            best = max(best or (0,), (matched, -x["item_ids"][0], start, n))
                    if best:
                        rows.append((piece.column(0)[i].as_py(), piece.column(1)[i].as_py(), sorted(ids), best[2], best[3], best[0]))
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "th", "item_ids", "start_word", "n_words", "n_matched"])
        give_back()

    return source.mapInArrow(run, _FOUND).dropDuplicates(["doc_id", "th"])


def _same_row(d: str, t: str) -> Column:
    return F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the contaminated rows. Nulls and repeated rows as in contaminated."""
    d, t = unused(docs.columns, "d", "t")
    found, _ = materialize(contaminated(docs, benchmark).select(F.col("doc_id").alias(d), F.col("th").alias(t)), "contaminated")
    return docs.join(found, _same_row(d, t), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, a row each, with the items whose passages they hold. Null and empty
    texts hold none; rows equal in doc_id and text are one; empty tables give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.array_join("item_ids", ",").alias("item_ids"), F.size("item_ids").cast("long").alias("n_items"), "start_word", "n_words", "n_matched")
