"""SimHash near-duplicates by one-wildcard (deletion) variants of fingerprint segments; near copies by MinHash and exact Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .blobs import give_back
from .common import materialize, sliced, text_bytes
from .components import connected_components
from .hamming import bucket_links, deletion_keys
from .textkernel import majority_bits, mix, shingles

MIN_JACCARD = 0.8
#: MinHash bands and rows of each: of pairs at MIN_JACCARD 1 in 20,000 shares no band, of more alike ones fewer.
BANDS, ROWS = 25, 5
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(2, -1)

#: Texts are hashed in slices of so many bytes.
SLICE = 1 << 20

SPACE = "[\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(text: Column, k: int) -> Column:
    """XXH64 (seed 42) of each k-word shingle, repeats included, of a text in which A-Z are lower case.
    Fewer words than k: of all words together. No word, or null: an empty array."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    words = F.filter(F.split(low, SPACE), lambda w: w != "")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + j) for j in range(k)))))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(many)

    return F.transform(F.array(words), hashes)[0]


def fingerprints(docs: DataFrame, k: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and fp (bigint): a bit is set if it is in over half of the shingles' hashes.
    Null or wordless texts have fingerprint zero. Shingles are cut and hashed in the worker, a slice of
    texts at a time: as arrays of the engine they fill the heap and, by the batch, as much beside it."""
    source = docs.select(*keep, F.col("text").alias("__text"))
    schema = source.drop("__text").schema.add("fp", "long", False)

    def run(batches):
        for whole in batches:
            for batch in sliced(whole, "__text", SLICE):
                fps = majority_bits(*shingles(*text_bytes(batch.column(batch.num_columns - 1)), k)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=[*keep, "fp"])
        give_back()

    return source.mapInArrow(run, schema)


def fingerprint_components(fps: DataFrame, distance: int = 4) -> DataFrame:
    """fps: fp. Returns fp, component for the fingerprints that have a link to another one; component
    is the smallest linked fingerprint. Equal fingerprints are one node, so copies cost nothing."""
    nodes, _ = materialize(fps.select("fp").distinct(), "fingerprints")
    keyed = nodes.select(F.explode(deletion_keys(F.col("fp"), distance, nodes.count())).alias("key"), "fp", F.col("fp").alias("id"))
    return connected_components(bucket_links(keyed, distance)).withColumnRenamed("node", "fp")


def simhash_components(fps: DataFrame, distance: int = 4) -> DataFrame:
    """fps: doc_id, fp. Returns doc_id, fp, component_id: the smallest doc_id of all rows that links of
    ``distance`` or fewer differing bits reach. Rows with a null doc_id take part; a group of only such
    rows has a null component_id."""
    spark = fps.sparkSession
    grouped, _ = materialize(fingerprint_components(fps, distance), "groups")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labelled = least.join(grouped, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named, _ = materialize(labelled.join(smallest, "component").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprint (hex) and component. Null and wordless texts share fingerprint
    zero; repeated rows stay; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fps, _ = materialize(fingerprints(docs), "fps")
    found = simhash_components(fps)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_sets(hashes: pa.Array):
    """(distinct shingles of all rows, first place of each row's and the end); no row is empty."""
    values = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    bounds = hashes.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    bounds -= bounds[0]
    sets = [np.unique(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets])))


def _node(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(values), bounds[:-1]) + np.diff(bounds).astype(np.uint64))


def _bands(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The MinHash bands of each set: a row of BANDS keys."""
    out = np.zeros((len(bounds) - 1, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for i, (xor, odd) in enumerate(zip(*_SEEDS)):
            least = np.minimum.reduceat((values ^ xor) * (odd | np.uint64(1)), bounds[:-1])
            out[:, i // ROWS] = mix(out[:, i // ROWS] ^ least + np.uint64(i))
    return out


def jaccard_alike(a: bytes, b: bytes, least: float = MIN_JACCARD) -> bool:
    """Whether two sets of distinct 64-bit numbers have at least that Jaccard similarity."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both) - 1e-9


def _sizes_fit(part: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = part["size"][i], part["size"][j]
    return np.minimum(a, b) >= MIN_JACCARD * np.maximum(a, b) - 1e-9


def _worded() -> Column:
    return F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, __th, node, fp and the bands of each row that has a word; equal shingle sets are one node."""
    source = docs.where(_worded()).select("doc_id", "__th", shingle_hashes(F.col("text"), k).alias("__h"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values, bounds = _shingle_sets(batch.column(2))
                fps = majority_bits(values, bounds).view(np.int64)
                keys = pa.array(_bands(values, bounds).view(np.int64).reshape(-1))
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(_node(values, bounds).view(np.int64)), pa.array(fps), pa.ListArray.from_arrays(ends, keys)], names=["doc_id", "__th", "node", "fp", "bands"])

    return source.mapInArrow(run, source.select("doc_id", "__th").schema.add("node", "long").add("fp", "long").add("bands", ArrayType(LongType())))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """id (a node), size and text: the bytes of its distinct shingles."""
    source = docs.select(shingle_hashes(F.col("text"), k).alias("__h"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values, bounds = _shingle_sets(batch.column(0))
                raw = pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(_node(values, bounds).view(np.int64)), pa.array(np.diff(bounds).astype(np.int32)), raw], names=["id", "size", "text"])

    return source.mapInArrow(run, "id long, size int, text binary").dropDuplicates(["id"])


def near_copies(docs: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text, __th. (rows, groups): the rows that have a word with their node, a shingle
    set, and node, component for the nodes that are linked to another one.

    Sets meet where deletion variants link their SimHashes, and by shared MinHash bands: of sets with a
    similarity of 0.9 one pair in ten has SimHashes within four bits. Only those that meet another fetch
    their shingles, and Jaccard similarity of at least MIN_JACCARD decides."""
    rows, _ = materialize(_sketches(docs, k), "sketches")
    nodes = rows.groupBy("node").agg(F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.min(F.struct("doc_id", "__th")).alias("at"))
    close, _ = materialize(fingerprint_components(rows), "close")
    keyed, _ = materialize(nodes.select(F.posexplode("bands").alias("band", "b"), "node", "at").select(F.xxhash64("band", "b").alias("key"), F.col("node").alias("id"), "at"), "bands")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    linked = nodes.select("node", "fp", "at").join(close, "fp").select(F.xxhash64(F.lit("SimHash"), "component").alias("key"), F.col("node").alias("id"), "at")
    met, _ = materialize(keyed.join(shared, "key").unionByName(linked), "met")
    wanted = met.select("at.doc_id", "at.__th").distinct().select(F.col("doc_id").alias("__d"), F.col("__th").alias("__t"))
    sets, _ = materialize(_sets(docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t"))), k), "sets")
    verified = met.select("key", "id").join(sets, "id").withColumn("fp", F.lit(0).cast("long"))
    links = bucket_links(verified, 64, jaccard_alike, chunk=4096, fits=_sizes_fit)
    return rows.select("doc_id", "__th", "node"), connected_components(links)


def one_of_each(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs without near copies: the row with the smallest (doc_id, text hash) of each group stays.

    Sets of shingles of five words, linked from a Jaccard similarity of MIN_JACCARD on. Documents
    without a word are no copies of each other here and all stay."""
    mark = docs.select("*", F.xxhash64("text").alias("__th"))
    rows, grouped = near_copies(mark.select("doc_id", "text", "__th"), k)
    labelled = rows.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best, _ = materialize(labelled.groupBy("component").agg(F.min(F.struct("doc_id", "__th")).alias("r")).select("r.*").distinct(), "kept")
    best = best.select(F.col("doc_id").alias("__d"), F.col("__th").alias("__h"))
    kept = mark.join(best, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__h")))
    wordless = mark.where(~_worded())
    return kept.dropDuplicates(["doc_id", "__th"]).select(docs.columns).union(wordless.select(docs.columns))
