"""Packing documents into token sequences: first-fit decreasing over a tournament tree of bins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import give_back
from .common import partitions, sliced
from .tokens import END_ID, default_tokenizer, tokenizer_at

_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item: items by falling length, each into the leftmost bin with room.

    The tree's leaves hold what is free in each bin, each inner node the larger of its children, so
    the leftmost fitting bin is found and updated in logarithmic time."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins = [0] * len(lengths)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need, node = lengths[item], 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        free[node] -= need
        bins[item] = node - leaves
        while node > 1:
            node //= 2
            best = free[2 * node] if free[2 * node] >= free[2 * node + 1] else free[2 * node + 1]
            if free[node] == best:
                break
            free[node] = best
    return bins


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, group_docs: int = 512, end: int = END_ID, seed: int = 7) -> DataFrame:
    """Pieces of documents with their place in sequences of at most ``capacity`` ids.

    A document's ids (its text's, then ``end``) are cut into full sequences and one rest; the rests of
    a randomised group of documents are packed by first-fit decreasing. Groups come from a hash of
    doc_id and text, about ``group_docs`` to a group, and are packed apart from each other; a group of
    many repeated rows is packed in runs of 4 * group_docs rests, and only rests, each below a sequence, are
    held, so memory stays bounded. Only the
    texts are shuffled, once, and the order in a partition is fixed, so a repeated task gives the same
    rows. Null text is empty: one piece with the end id. Null doc_id stays null."""
    spark = docs.sparkSession
    groups = max(1, -(-docs.count() // group_docs))
    mixed = F.xxhash64(F.lit(seed), "doc_id", "text")
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.pmod(mixed, F.lit(groups)).alias("grp"), mixed.alias("mixed"))
        .repartition(partitions(spark), "grp")
        .sortWithinPartitions("grp", "mixed", "doc_id")
        .select("doc_id", "text", "grp")
    )
    limit = 4 * group_docs

    def rows(group: int, used: int, rests: list[tuple]) -> tuple[int, list]:
        """The pieces that the rests make, and the count of the group's sequences."""
        out = []
        bins = first_fit_decreasing([len(ids) for _, _, ids, _ in rests], capacity)
        filled: dict[int, int] = {}
        for (doc_id, at, ids, total), box in zip(rests, bins):
            out.append((doc_id, at, len(ids), ids, total, (group << 32) + used + box, filled.get(box, 0)))
            filled[box] = filled.get(box, 0) + len(ids)
        return used + max(bins, default=-1) + 1, out

    def batch(part: list[tuple]) -> pa.RecordBatch:
        doc_id, start, length, ids, total, seq, offset = zip(*part)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_id, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length)), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), *(pa.array(x, pa.int64()) for x in (total, seq, offset))],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )

    def run(batches):
        encoder = tokenizer_at(tokenizer)
        group, used, rests, out, size = None, 0, [], [], 0
        for whole in batches:
            for piece in sliced(whole, "text", 2 << 20):
                all_ids, offsets = encoder.encode(piece.column(1), end)
                for i, (doc_id, g) in enumerate(zip(piece.column(0).to_pylist(), piece.column(2).to_pylist())):
                    if g != group or len(rests) >= limit:
                        used, found = rows(group, used, rests)
                        out += found
                        size += sum(len(r[3]) for r in found)
                        rests = []
                        if g != group:
                            group, used = g, 0
                    ids = all_ids[offsets[i] : offsets[i + 1]]
                    full = len(ids) // capacity * capacity
                    for at in range(0, full, capacity):  # a full sequence is final at once
                        out.append((doc_id, at, capacity, ids[at : at + capacity], len(ids), (group << 32) + used, 0))
                        used += 1
                    if full < len(ids):
                        rests.append((doc_id, full, ids[full:].copy(), len(ids)))
                    size += full
                    if size >= 1 << 20:
                        yield batch(out)
                        out, size = [], 0
        out += rows(group, used, rests)[1]
        if out:
            yield batch(out)
        give_back()

    return dealt.mapInArrow(run, _PIECES)


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The pieces with a checksum in place of their ids, of any table with doc_id and text; other columns
    don't count. Null and empty texts make one piece of the end id; no rows make none."""
    pieces = pack(docs, tokenizer or default_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces. Null and empty texts are one id, the end; repeated rows are packed each;
    an empty table gives no rows."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
