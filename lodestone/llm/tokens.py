"""Word-cached encoding with a public tokenizer, and flat token files read back by memory map."""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, scratch, sliced

END_ID = 1
RUN = 1 << 15  #: words whose ids are put in place at once


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The parts of a tokenizer file that the encoding of single words relies on.
WORDWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordTokenizer:
    """Encodes texts word by word with the tokenizers library, keeping the ids of words seen.

    That equals encoding whole texts where the normalizer and the pre-tokenizer are those of WORDWISE:
    pre-tokens never span ASCII white space, and letters and points are apart. With any other tokenizer
    texts are encoded whole. The cache holds ``most`` words, or those of one call; when full it keeps only words
    that the texts at hand hold too, so memory is bounded."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in parts["added_tokens"]]
        self.wordwise = all(parts[k] == v for k, v in WORDWISE.items()) and all(t.startswith("<|") and len(t.split()) == 1 for t in added)
        self._apart: dict[str, bool] = {}
        #: The same model for lower-case ASCII words between spaces, which need no normalising.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  #: ids that end a pre-token
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.most = most
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {}

    def _parts_from_points(self, letter: str) -> bool:
        """Whether a word that ends in this character has a pre-token end there before a point. Some
        letters don't: the lower case of a capital I with a dot ends in a combining mark."""
        if letter not in self._apart:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(letter + ".,"))
            self._apart[letter] = letter.isalpha() and bool(cut) and cut[-1][0] == ".,"
        return self._apart[letter]

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word. A word that ends in letters and then points or commas is the sum of
        both parts, and ASCII words are encoded in lower case, as the tokenizer itself would; words that
        may hold a special token are encoded as they are."""
        cache, parts, new = self.cache, [], {}
        for word in words:
            stem, tail = word.rstrip(".,"), ""
            if "<|" in word:
                stem = word
            else:
                if len(stem) < len(word):
                    if stem and self._parts_from_points(stem[-1]):
                        tail = word[len(stem) :]
                        if tail not in cache:
                            new[tail] = None
                    else:
                        stem = word
                if stem.isascii():
                    stem = stem.lower()
            parts.append((stem, tail))
            if stem not in cache:
                new[stem] = None
        if len(cache) + len(new) > self.most:
            kept = {word: cache[word] for pair in parts for word in pair if word in cache}
            cache.clear()
            cache.update(kept)
        simple, letters, rest = [], [], []
        for word in new:
            (rest if not word.isalpha() else simple if word.isascii() and word.islower() else letters).append(word)
        self._runs(self.plain, simple)
        self._runs(self.tokenizer, letters)
        self._each(rest)
        return [cache[stem] + cache[tail] if tail else cache[stem] for stem, tail in parts]

    def _runs(self, tokenizer, words: list[str]) -> None:
        """Words of letters alone are one pre-token each: they are encoded in one text, and cut where an
        id ends a pre-token. Should the count differ (letters that split in lower case), each is encoded
        apart."""
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                self._each(part)
                continue
            raw, size, at = ids.tobytes(), self.kind.itemsize, 0
            for word, end in zip(part, (ends * size).tolist()):
                self.cache[word] = raw[at:end]
                at = end

    def _each(self, words: list[str]) -> None:
        if words:
            for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
                self.cache[word] = np.array(found.ids, self.kind).tobytes()

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, each closed by ``end``, and the texts' offsets."""
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        if not self.wordwise:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            tail = [] if end is None else [end]
            own = [np.array(x.ids + tail, self.kind) for x in found]
            return np.concatenate([np.zeros(0, self.kind), *own]), np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        own = self._ids(words)
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // self.kind.itemsize
        table = np.frombuffer(b"".join(own), self.kind)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes[codes], out=ends[1:])
        raw = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = ends[raw - raw[0]]
        begin = np.cumsum(sizes) - sizes
        ids = np.empty(ends[-1], self.kind)
        for a in range(0, len(codes), RUN):  # an index for each id takes four times the ids: a run of words at a time
            part, at = codes[a : a + RUN], ends[a : a + RUN + 1]
            ids[at[0] : at[-1]] = table[np.repeat(begin[part] - at[:-1], np.diff(at)) + np.arange(at[0], at[-1])]
        if end is None:
            return ids, bounds
        offsets = bounds + np.arange(len(bounds))
        closed = np.empty(offsets[-1], self.kind)
        closed[offsets[1:] - 1] = end
        keep = np.ones(offsets[-1], bool)
        keep[offsets[1:] - 1] = False
        closed[keep] = ids
        return closed, offsets


_loaded: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One tokenizer, and one cache, for each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


NULL_ID = -(1 << 63)
_MANIFEST = "part int, file string, docs long, tokens long, width int"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = END_ID) -> list[dict]:
    """Encode all texts and write flat files of unsigned ids in ascending order of key.

    Each range of keys becomes NAME.bin (ids, 16 bits wide where the vocabulary fits, else 32),
    NAME.idx (unsigned 64-bit offsets of its documents, one more than there are documents) and
    NAME.key (signed 64-bit keys, -2**63 for null). A task writes under names of its own and reports
    them only when done, so a repeated task leaves no partial file in the list. Returns one entry per
    file in order, with base: ids in all files before it, the prefix sum of the counts.

    ``folder`` is a URI on storage that all executors share."""
    spark = docs.sparkSession
    n = partitions(spark)

    def run(batches):
        from pyarrow import fs

        encoder = tokenizer_at(tokenizer)
        part = TaskContext.get().partitionId()
        store, at = fs.FileSystem.from_uri(folder)
        name = f"{part:06d}-{uuid.uuid4().hex}"
        count, total, out = 0, 0, None
        try:
            for batch in batches:
                for piece in sliced(batch, text, 4 << 20):
                    if out is None:
                        store.create_dir(at, recursive=True)
                        out = {x: store.open_output_stream(f"{at}/{name}.{x}") for x in ("bin", "idx", "key")}
                        out["idx"].write(np.zeros(1, "<u8").tobytes())
                    ids, offsets = encoder.encode(piece.column(1), end)
                    out["bin"].write(ids.tobytes())
                    out["idx"].write((offsets[1:] + total).astype("<u8").tobytes())
                    out["key"].write(pc.fill_null(piece.column(0), NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    count, total = count + piece.num_rows, total + len(ids)
        finally:
            for stream in (out or {}).values():
                stream.close()
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([name]), pa.array([count]), pa.array([total]), pa.array([encoder.kind.itemsize], pa.int32())],
                names=["part", "file", "docs", "tokens", "width"],
            )

    ordered = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)).repartitionByRange(n, key).sortWithinPartitions(key, text)
    manifest = [r.asDict() for r in ordered.mapInArrow(run, _MANIFEST).collect()]  # a row for each file
    manifest.sort(key=lambda r: r["part"])
    _drop_others(spark, folder, {r["file"] for r in manifest})
    base = 0
    for r in manifest:
        r["base"], base = base, base + r["tokens"]
    return manifest


class _Ranges:
    """Slices of a file in a store that can't be mapped, read when asked for."""

    def __init__(self, store, path: str, kind: str):
        self._file, self._kind = store.open_input_file(path), np.dtype(kind)

    def __len__(self) -> int:
        return self._file.size() // self._kind.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        a, b, _ = part.indices(len(self))
        return np.frombuffer(self._file.read_at(max(b - a, 0) * self._kind.itemsize, a * self._kind.itemsize), self._kind)


def open_token_file(folder: str, name: str, width: int) -> tuple:
    """ids, offsets and keys of one file: memory-mapped where the store is a file system, else read by
    the slice."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    kinds = {"bin": f"<u{width}", "idx": "<u8", "key": "<i8"}
    if isinstance(store, fs.LocalFileSystem):
        return tuple(np.memmap(f"{at}/{name}.{x}", dtype=k, mode="r") for x, k in kinds.items())
    return tuple(_Ranges(store, f"{at}/{name}.{x}", k) for x, k in kinds.items())


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI; a bare path is on the cluster's default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + found[5:] if found.startswith("file:/") and not found.startswith("file://") else found


def _drop_others(spark: SparkSession, folder: str, names: set[str]) -> None:
    """Delete the files of attempts that weren't the ones to report."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(path):
        for status in store.listStatus(path):
            if status.getPath().getName().rpartition(".")[0] not in names:
                store.delete(status.getPath(), False)


def read_token_files(spark: SparkSession, folder: str, manifest: list[dict]) -> DataFrame:
    """One row per document from the files: key, start (ids before it in all files), n_tokens, ids
    (its ids as little-endian unsigned 32-bit integers)."""
    rows = [(r["file"], r["base"], r["width"]) for r in manifest]
    files = spark.createDataFrame(rows, "file string, base long, width int").repartition(max(1, len(rows)))

    def run(batches):
        for batch in batches:
            for name, base, width in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids, offsets, keys = open_token_file(folder, name, width)
                step = 1000
                for a in range(0, len(keys), step):
                    b = min(len(keys), a + step)
                    marks = offsets[a : b + 1].astype(np.int64)
                    part = np.asarray(ids[marks[0] : marks[-1]]).astype("<u4")
                    cuts = (marks - marks[0]) * 4
                    own = np.asarray(keys[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, pa.int64(), mask=own == NULL_ID),
                            pa.array(marks[:-1] + base),
                            pa.array(np.diff(marks)),
                            pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(part.tobytes())]).cast(pa.binary()),
                        ],
                        names=["key", "start", "n_tokens", "ids"],
                    )

    return files.mapInArrow(run, "key long, start long, n_tokens long, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents as flat token files, read back. Null text is empty: its end id alone. Rows with
    one doc_id follow each other in the order of their texts; an empty table writes no file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = qualified(spark, scratch(spark, "tokens"))
    manifest = write_token_files(docs, folder, tokenizer or default_tokenizer())
    found = read_token_files(spark, folder, manifest)
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
