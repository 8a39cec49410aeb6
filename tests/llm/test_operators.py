"""Each operator against brute force on a table of hard cases, and on an empty one."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

import corpus_pipeline
from lodestone.llm import decontam, hamming, licenses, lines, packing, pii, quality, registry, shards, simhash, substrings, tokens
from lodestone.llm.components import connected_components

Q = registry.queries()
BENCH = [(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"), (1, None), (2, ""), (3, "one two three four five six")]


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [None, "", "  \n ", "one", "A b c", "x" * 150 + "é" * 60, prose(80), prose(3000)]
    base = prose(120)
    texts += [base, base, base + " tail", base.replace(" ", "  ", 1), base.upper(), "head " + base]
    changed = base.split()
    changed[50] = "zzz"
    texts.append(" ".join(changed))
    texts.append("Mail a.b@c.example.org or a@b.co_x@y.z, call +1 (212) 555-0199; then 1.2.3.4.5.6.7.8 and 300.1.1.1, card 4111 1111 1111 1111 or 4111111111111112 é token = \"d4e71e33b54f40bc277a32011430a66d\"")
    texts.append(prose(10) + " " + BENCH[0][1].replace("kappa", "KAPPA!").replace("mu", "other") + " " + prose(10))
    texts.append("One, two three FOUR five six.")
    line = prose(12)
    texts.append("\n".join([line, prose(9), line.capitalize() + ".", line, "short one", "short one"]))
    texts.append("Words.\nLicensed under the Apache License,\nVersion 2.0.\nPermission is granted. All rights reserved.")
    texts += ["ab " * 400, "<|endoftext|> The.THE <|EndOfText|>. it's ,.", prose(200) + base]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, prose(60)), (9, texts[9]), (1000, base)]


def write(folder, rows):
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    n = len(rows)
    docs = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en", None] * (n // 2) + ["en"] * (n % 2), pa.string()), "source": pa.array(["s"] * n, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    docs |= {k: pa.array(["clash"] * n, pa.string()) for k in ("key", "grp", "bin", "component", "fp", "spans", "drops")}
    pq.write_table(pa.table(docs), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([b[0] for b in BENCH], pa.int64()), "text": pa.array([b[1] for b in BENCH], pa.string())}), f"{folder}/benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([6, 7, None], pa.int64()), "quality": pa.array([1, None, 0], pa.int32()), "toxic": pa.array([0, 0, 0], pa.int32())}), f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def hard(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hard"))
    write(folder, corpus())
    return folder


def run(spark, name, folder):
    return [r.asDict() for r in Q[next(n for n in Q if n.startswith(f"{name}_"))](spark, folder).collect()]


def counted(rows):
    return collections.Counter(map(tuple, rows))


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_table(spark, tmp_path, name):
    write(str(tmp_path), [])
    assert Q[name](spark, str(tmp_path)).collect() == []


def test_pii(spark, hard):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            return 16 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in v) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    want = []
    for i, t in corpus():
        found = {k: [m for m in re.finditer(p, t or "") if good(k, m[0])] for k, p in patterns.items()}
        joined = ",".join(f"{k}:{m.start()}:{m.end()}" for k, f in found.items() for m in f)
        want.append((i, *(len(f) for f in found.values()), hashlib.sha256(joined.encode()).hexdigest()))
    got = run(spark, "op1", hard)
    assert counted((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == counted(want)


def test_spans_of_long_texts(spark):
    """Positions of many matches, over several blocks, against regular expressions; spans apart."""
    rng = random.Random(6)
    mail = " ".join(f"é u{i}@ex{i % 7}.org, {rng.randint(10, 99)} 10.0.{i % 300}.1" for i in range(3000))
    texts = [mail, " ".join(str(rng.randint(10, 99)) for _ in range(100_000)), "; ".join(f"token=abcDEF1234567890{i:08d}" for i in range(700))]
    rows = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    got = [(x.s, x.e) for x in rows[0]["spans"] if x.k == 0]
    assert got == [m.span() for m in re.finditer("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", mail)]
    good = [m.span() for m in re.finditer("[0-9]+(?:\\.[0-9]+){3}", mail) if all(int(x) <= 255 for x in m.group().split("."))]
    assert [(x.s, x.e) for x in rows[0]["spans"] if x.k == 1 and x.base] == good
    assert not rows[1]["spans"]
    for r in rows:
        for x in r["spans"]:
            assert x.base or not any(y != x and y.s < x.e and x.s < y.e for y in r["spans"])


def test_labelers_and_redaction(spark, hard):
    votes = [(0, (1, 1, 1, 0, 1), 50.0), (0, (-1, -1, 0, -1, -1), 40.0), (0, (1, -1, 0, 0, 1), 3.0)]
    post, reliable = pii.fit_labelers(votes)
    assert post[0, (1, 1, 1, 0, 1)] > 0.9 > 0.1 > post[0, (-1, -1, 0, -1, -1)]
    assert all(0 <= x <= 1 for x in reliable.values())
    clean = pii.redact(spark.read.parquet(f"{hard}/documents.parquet")).where("text like 'Mail%'").first()["text"]
    assert "<email>" in clean and "<phone>" in clean and "a.b@c" not in clean


@given(st.lists(st.integers(1, 100), max_size=60))
def test_first_fit(sizes):
    free, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((b for b, f in enumerate(free) if f >= sizes[i]), None)
        if at is None:
            free.append(100)
            at = len(free) - 1
        free[at] -= sizes[i]
        want[i] = at
    assert packing.first_fit_decreasing(sizes, 100) == [want[i] for i in range(len(sizes))]


@pytest.fixture(scope="module")
def encoded():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    return [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t in corpus()]


def test_token_files(spark, hard, encoded):
    start, want = 0, []
    for i, ids in sorted(encoded, key=lambda x: (x[0] is not None, x[0])):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert counted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, "op9", hard)) == counted(want)


def test_words_are_encoded_as_texts_are():
    """Ids of word-wise encoding against the tokenizer's own over texts of odd letters, marks and signs."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_tokenizer())
    fast = tokens.WordTokenizer(tokens.default_tokenizer())
    assert fast.wordwise
    rng = random.Random(1)
    odd = ["İ", "ı", "ß", "ẞ", "Σ", "ς", "ŉ", "ǰ", "ﬁ", "é", "e\u0301", "\u0307", "\u0300", "\u200d", "\u00a0", "\u2028", "\x1c", "\x85", "日", "한", "ᄒ", "ᅡ", "ั", "ก", "𝐀", "🙂", "٣", "Ⅷ", "²", "ª", "ʰ", "ǅ", "Ω", "K", "\u0345"]
    pieces = [*odd, *"abzABIZ019", ".", ",", "...", "'s", "'", "'LL", "-", "<|", "|>", "<|endoftext|>", "_", " ", " ", "\n", "\t", "\u3000"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(60_000)]
    texts += [chr(c) + t for c in range(32, 0x3000) if chr(c).isalpha() for t in (".", ",a", "x.")]
    ids, offsets = fast.encode(pa.array(texts))
    want = [x.ids + [1] for x in own.encode_batch_fast(texts, add_special_tokens=False)]
    bad = [t for t, w, a, b in zip(texts, want, offsets[:-1], offsets[1:]) if ids[a:b].tolist() != w]
    assert not bad, bad[:5]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    parts = json.load(open(tokens.default_tokenizer()))
    parts["normalizer"] = {"type": "NFC"}
    (tmp_path / "cased.json").write_text(json.dumps(parts))
    other = tokens.WordTokenizer(str(tmp_path / "cased.json"))
    assert not other.wordwise
    texts = ["Ab  CD.", "", None, "a b"]
    ids, offsets = other.encode(pa.array(texts))
    for t, a, b in zip(texts, offsets[:-1], offsets[1:]):
        assert ids[a:b].tolist() == other.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]


def test_ranges_of_a_store(tmp_path):
    from pyarrow import fs

    np.arange(100, dtype="<u8").tofile(tmp_path / "x.idx")
    found = tokens._Ranges(fs.LocalFileSystem(), str(tmp_path / "x.idx"), "<u8")
    assert len(found) == 100 and found[3:7].tolist() == [3, 4, 5, 6] and found[98:120].tolist() == [98, 99]


def test_small_cache_gives_the_same():
    texts = pa.array([t for _, t in corpus()])
    a, b = tokens.WordTokenizer(tokens.default_tokenizer(), 10), tokens.WordTokenizer(tokens.default_tokenizer())
    for x, y in zip(a.encode(texts), b.encode(texts)):
        assert (x == y).all()


def test_encoding_takes_bounded_memory():
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 500, 2000)) for _ in range(400)])
    encoder = tokens.WordTokenizer(tokens.default_tokenizer())
    encoder.encode(texts)
    tracemalloc.start()
    encoder.encode(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * texts.nbytes


def test_full_cache_keeps_the_words_in_use():
    encoder, fresh = (tokens.WordTokenizer(tokens.default_tokenizer(), n) for n in (150, 1_000_000))
    common = " ".join(f"often{i}" for i in range(50))
    for k in range(20):
        texts = pa.array([f"{common} " + " ".join(f"once{k}x{i}" for i in range(40))])
        for x, y in zip(encoder.encode(texts), fresh.encode(texts)):
            assert (x == y).all()
        assert len(encoder.cache) <= 150 and all(w in encoder.cache for w in common.split())
    calls = []
    encoder._each = lambda words: calls.extend(words)
    encoder.encode(pa.array([common]))
    assert not calls


def test_packing(spark, hard, encoded):
    got = run(spark, "op2", hard)
    known = collections.defaultdict(list)
    for i, ids in encoded:
        known[i].append(ids)
    total = collections.Counter()
    boxes = collections.defaultdict(list)
    for r in got:
        assert any(len(ids) == r["doc_tokens"] and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for ids in known[r["doc_id"]])
        total[r["doc_id"]] += r["length"]
        boxes[r["sequence_id"]].append((r["offset"], r["length"]))
    assert total == {i: sum(map(len, x)) for i, x in known.items()}
    for box in boxes.values():
        at = 0
        for offset, length in sorted(box):
            assert offset == at
            at += length
        assert at <= 2048


def test_jump_hash(spark, hard):
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = shards.jump(keys, 40), shards.jump(keys, 41)
    moved = a != b
    assert (b[moved] == 40).all() and abs(moved.mean() - 1 / 41) < 0.005 and np.bincount(a, minlength=40).min() > 400
    got = run(spark, "op5", hard)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = counted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in corpus())
    assert counted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def fingerprint(text, k):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    out = 0
    for bit in range(64):
        out |= (2 * sum(xxhash.xxh64_intdigest(g.encode(), 42) >> bit & 1 for g in grams) > len(grams)) << bit
    return out


def groups(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if label[i] != label[j] and linked(i, j):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def test_simhash(spark, hard):
    rows = corpus()
    fps = [fingerprint(t, 4) for _, t in rows]
    label = groups(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    least = {}
    for (i, _), x in zip(rows, label):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    want = counted((i, f"{f:016x}", least.get(x)) for (i, _), f, x in zip(rows, fps, label))
    assert counted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in run(spark, "op4", hard)) == want


def test_lines_that_stand_alone_go_no_further(spark, monkeypatch):
    rng = random.Random(8)
    line = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(7))
    texts = [line() + "\n" + line() for _ in range(40)]
    texts[30] += "\n" + texts[4].split("\n")[1].upper()
    rows = {}

    def counting(df, tag):
        found, path = materialize(df, tag)
        rows[tag] = found.count()
        return found, path

    materialize = lines.materialize
    monkeypatch.setattr(lines, "materialize", counting)
    found = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "ShuffledHashJoin" in plan  # texts aren't sorted
    texts[30] = texts[30].rsplit("\n", 1)[0]
    assert [r["text"] for r in found.orderBy("doc_id").collect()] == texts
    assert (rows["firsts"], rows["several"], rows["drops"]) == (80, 1, 1)


def test_shingles_are_hashed_in_slices(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("aBZé€😀.0") for _ in range(n))
    space = lambda: rng.choice([" ", "  ", "\t", "\n", "\x0b", "\x0c\r", "\x1c "])
    texts = [None, "", " \n", *(word(n) for n in range(1, 140)), *("".join(word(rng.randint(1, 30)) + space() for _ in range(n)) for n in range(1, 60)), "", word(70_000) + " b " + word(9)]
    fps = [fingerprint(t, 4) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = simhash.fingerprints(docs)
    assert "hash" not in found._jdf.queryExecution().optimizedPlan().toString()  # no array of them in the heap, nor in a batch
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in found.collect()} == dict(enumerate(fps))


@pytest.mark.parametrize(("chunk", "rows"), [(4096, 100), (8, 100), (8, 1 << 34)])
def test_hot_buckets_lose_no_link(spark, chunk, rows):
    from pyspark.sql import functions as F

    rng = random.Random(chunk)
    center = rng.getrandbits(64)
    fps = list({center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)})
    df = spark.createDataFrame([(hamming.signed(f),) for f in fps], "fp long")
    distance = 4
    for chunk in (chunk, 3 * chunk):
        keyed = df.select(F.explode(hamming.deletion_keys(F.col("fp"), distance, rows)).alias("key"), "fp", F.col("fp").alias("id"))
        found = connected_components(hamming.bucket_links(keyed, distance, chunk=chunk))
        got = {r["node"]: r["component"] for r in found.collect()}
        label = groups(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= distance)
        want = {}
        for x in set(label):
            members = [hamming.signed(f) for f, y in zip(fps, label) if y == x]
            want |= {m: min(members) for m in members if len(members) > 1}
        assert got == want


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 150), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {150: 150, 200: 150}


def test_decontamination(spark, hard):
    got = {r["doc_id"]: r for r in run(spark, "op3", hard)}
    assert set(got) == {16, 17} and got[16]["item_ids"] == "0" and got[17]["item_ids"] == "3"
    assert got[16]["n_words"] == 20 and got[16]["n_matched"] == 19 and got[16]["start_word"] == 10
    docs, bench = spark.read.parquet(f"{hard}/documents.parquet"), spark.read.parquet(f"{hard}/benchmark.parquet")
    assert decontam.clean(docs, bench).count() == docs.count() - 2
    assert set(r["doc_id"] for r in decontam.contaminated(docs.withColumn("th", docs.text), bench).collect()) == {16, 17}
    twice = spark.createDataFrame([(None, "one two three four five six"), (None, "x one two three four five six"), (None, "x one two three four five six")], "doc_id long, text string")
    assert decontam.contaminated(twice, bench).count() == 2 and decontam.clean(twice, bench).count() == 0


@given(st.lists(st.sampled_from([True, True, True, False]), max_size=40))
def test_best_run(same):
    runs = [sum(same[a:b]) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if 5 * sum(same[a:b]) >= 4 * (b - a)]
    start, end, matched = decontam.best_run(np.array(same, bool))
    assert matched == max(runs, default=0) == sum(same[start:end]) and 5 * matched >= 4 * (end - start)


def overlaps(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_a_clean_stretch_hides_no_passage(spark):
    item = [f"w{i}" for i in range(18)]
    text = " ".join("x" if i in (11, 13) else w for i, w in enumerate(item))
    got = overlaps(spark, [(7, " ".join(item))], [f"head {text} tail"])[0]
    assert (got["item_ids"], got["start_word"], got["n_words"], got["n_matched"]) == ([7], 1, 18, 16)


def test_seeds_miss_no_run():
    # items that ask for fewer equal words: all placements
    for n in range(1, 16):
        masks = [int(m, 2) for m in decontam.masks_of(n)]
        for bits in range(1 << n):
            if bits.bit_count() >= decontam.needed(n):
                assert any(bits >> i & m == m for m in masks for i in range(n))
    # the others, by the last five words: the best score (1 for an equal word, -4 for another) of a run without a seed
    masks = [int(m, 2) for m in decontam.masks_of(16)]
    assert all(decontam.masks_of(n) == decontam.MASKS for n in range(16, 200))
    best = {(0, 0): 0}
    for _ in range(200):
        step = {}
        for (last, count), score in best.items():
            for same in (0, 1):
                now = last << 1 | same
                if not any(now & m == m for m in masks):
                    key = now & 31, min(decontam.MIN_WORDS, count + same)
                    step[key] = max(step.get(key, -1000), score + (1 if same else -4))
        best = step
        assert all(score < 0 for (_, count), score in best.items() if count == decontam.MIN_WORDS)


def test_every_fifth_word_substituted(spark):
    rng = random.Random(8)
    item = [f"w{i}" for i in range(100)]
    texts = [" ".join("x" if i % 5 == first else w for i, w in enumerate(item)) for first in range(5)]
    assert set(overlaps(spark, [(7, " ".join(item))], texts)) == set(range(5))
    got = overlaps(spark, [(7, " ".join(item[:9]))], [" ".join([*item[:4], "x", *item[5:9]])])[0]
    assert (got["start_word"], got["n_words"], got["n_matched"]) == (0, 9, 8)
    # against all diagonals and runs
    items = [(i, " ".join(rng.choices("abcdefgh", k=rng.choice([1, 3, 5, 7, 9, 12, 15, 17, 25])))) for i in range(30)]
    texts = ["", *(" ".join(w if rng.random() < 0.85 else rng.choice("abxy") for w in (rng.choice("abz ") + " " + t).split()) for _, t in items)]
    found = overlaps(spark, items, texts)
    want = {}
    for i, t in items:
        own = t.split()
        for row, text in enumerate(texts):
            w = text.split()
            for d in range(-len(own), len(w)):
                same = [own[p - d] == w[p] for p in range(max(d, 0), min(d + len(own), len(w)))]
                for a in range(len(same)):
                    for b in range(a + 1, len(same) + 1):
                        n = sum(same[a:b])
                        if 5 * n >= 4 * (b - a) and n >= min(13, -(-4 * len(own) // 5)):
                            want[row, i] = max(n, want.get((row, i), 0))
    assert {(row, i) for row, r in found.items() for i in r["item_ids"]} == set(want) and len(want) > 20
    assert all(r["n_matched"] == max(n for (x, _), n in want.items() if x == row) for row, r in found.items())


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    assert lines.edit_distance(a, b) == row[-1]
    assert lines.edit_distance(a, b, 3) == row[-1] if row[-1] <= 3 else lines.edit_distance(a, b, 3) > 3


def test_edit_distances_side_by_side():
    rng = random.Random(2)
    letters = lambda n: "".join(rng.choice("abcé日") for _ in range(n))
    for n in (0, 1, 63, 64, 65, 200):
        a = letters(n)
        texts = ["", a, letters(70)] + [edited(rng, lambda: letters(3), a or "a", "letter", rng.randint(1, 9)) + letters(rng.randint(0, 9)) for _ in range(40)]
        exact = np.array([lines.edit_distance(a, b) for b in texts])
        most = np.array([rng.choice([5, 10, 300]) for _ in texts])
        got = lines.edit_distances(a, texts, most)
        assert ((got == exact) | (got > most) & (exact > most)).all()
        assert lines.similar_to(a, texts).tolist() == [lines.similar(a, b) for b in texts]


def test_edit_distances_of_many_pairs():
    rng = np.random.default_rng(5)
    for letters, length in (("ab ", 70), ("añß漢字 é", 150), ("".join(map(chr, range(0x4E00, 0x4E00 + 300))), 90)):
        firsts, seconds = [], []
        for _ in range(200):
            a = "".join(rng.choice(list(letters), rng.integers(0, length)))
            b = list(a)
            for _ in range(rng.integers(0, 1 + len(a) // 3)):
                b.insert(int(rng.integers(0, len(b) + 1)), str(rng.choice(list(letters))))
            b = "".join(b) if rng.random() < 0.8 else "".join(rng.choice(list(letters), rng.integers(0, length)))
            firsts.append(a)
            seconds.append(b)
        exact = np.array([lines.edit_distance(a, b) for a, b in zip(firsts, seconds)])
        for most in (np.full(200, 10_000), np.array([max(len(a), len(b)) // 5 for a, b in zip(firsts, seconds)])):
            got = lines.edit_distances(firsts, seconds, most)
            assert np.array_equal(np.minimum(got, most + 1), np.minimum(exact, most + 1))
        assert lines.within(firsts, seconds).tolist() == [lines.similar(a, b) for a, b in zip(firsts, seconds)]
        assert all(lines.similar(a, b) is s for a, b, s in zip(firsts, seconds, map(lines.surely_similar, firsts, seconds)) if s is not None)


def test_units_of_lines_in_any_order():
    texts = ["zebra crossing\nalpha beta gamma delta eps\nmenu item", "home page now\nabout us\nünïcode wörd 漢字"]
    taken = lines.Lines(pa.array(texts))
    hashes, bounds, _ = taken.units(np.arange(6))
    for order in ([5, 0, 3, 1, 4, 2], [2, 4]):
        some, cut, _ = taken.units(np.array(order))
        for place, i in enumerate(order):
            assert np.array_equal(some[cut[place] : cut[place + 1]], hashes[bounds[i] : bounds[i + 1]])
    assert taken.sizes().tolist() == [len(lines.normalised(x.encode())) for t in texts for x in t.split("\n")]


@pytest.mark.parametrize("chunk", [40, 512])
def test_pairs_left_open_are_decided_together(spark, chunk):
    rows = [(k, 0, 1000 * k + i, f"{i % 7}") for k in range(3) for i in range(k * 45 + 10)]
    keyed = spark.createDataFrame(rows, "key long, fp long, id long, text string")
    links = hamming.bucket_links(keyed, 64, lambda a, b: None if a == b else False, chunk=chunk, decide=lambda a, b: np.array([x == y for x, y in zip(a, b)]))
    got = {(r["node"], r["component"]) for r in connected_components(links).collect()}
    assert got == {(i, i // 1000 * 1000 + int(t)) for _, _, i, t in rows if any(t == u and i != j and i // 1000 == j // 1000 for _, _, j, u in rows)}


def test_majority_bits():
    from lodestone.llm.textkernel import majority_bits

    rng = np.random.default_rng(4)
    sizes = [0, 1, 2, 254, 255, 256, 511, 0, 3, 700_000, 5, 0]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    hashes = rng.integers(0, 1 << 63, bounds[-1], dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, bounds[-1], dtype=np.uint64)
    hashes[::3] = hashes[0]
    bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    for got, a, b in zip(majority_bits(hashes, bounds).tolist(), bounds[:-1], bounds[1:]):
        assert got == sum(1 << i for i, c in enumerate(bits[a:b].sum(axis=0).tolist()) if 2 * c > b - a)


def normal(line):
    return lines.normalised(line.encode())


def kept_lines(rows, alike):
    """The rows' texts by brute force: of each connected group of lines the first by (doc_id, text hash, line) stays."""
    found = []
    for i, (doc, t) in enumerate(rows):
        for j, x in enumerate((t or "").split("\n")):
            if normal(x):
                found.append(((-1 if doc is None else doc, i), j, normal(x)))
    found.sort(key=lambda x: x[:2])
    label = groups(len(found), lambda i, j: alike(found[i][2], found[j][2]))
    gone = {(x[0][1], x[1]) for k, x in enumerate(found) if label.index(label[k]) != k}
    return ["\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) if t is not None else None for i, (_, t) in enumerate(rows)]


def test_line_dedup(spark, hard):
    rows = corpus()
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    got = {(r["doc_id"], r["text"]) for r in lines.dedup_lines(docs.where("doc_id in (18)")).collect()}
    text = dict(rows)[18].split("\n")
    assert got == {(18, "\n".join([text[0], text[1], "short one"]))}
    whole = lines.dedup_lines(docs)
    assert whole.columns == [*docs.columns, "n_lines", "n_dropped"]
    want = kept_lines(rows, lambda a, b: a == b or lines.similar(a, b))
    assert counted((r["doc_id"], r["text"]) for r in whole.collect()) == counted((i, t) for (i, _), t in zip(rows, want))
    assert len(run(spark, "op6", hard)) == len(rows)


def test_line_dedup_by_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "x y z\nx y z", "a", "b"), (1, "x y z\nx y z", "c", "d")], "doc_id int, text string, __h string, __gone string")
    got = [tuple(r) for r in lines.dedup_lines(df).collect()]
    assert sorted(r[1] for r in got) == ["", "x y z"] and {r[2:4] for r in got} == {("a", "b"), ("c", "d")} and {r[4] for r in got} == {2}


def edited(rng, word, line, kind, count):
    own = line.split(" ")
    for _ in range(count):
        at = rng.randrange(len(own))
        if kind == "word":
            own[at] = word()
        elif kind == "letter":
            k = rng.randrange(len(own[at]))
            own[at] = own[at][:k] + "w" + own[at][k + 1 :]
        elif kind == "insert":
            own.insert(at, word())
        elif len(own) > 1:
            del own[at]
    return " ".join(own)


@pytest.mark.parametrize("size", [6, 8, 10, 15, 20, 30, 40, 80])
@pytest.mark.parametrize(("kind", "count"), [("word", 1), ("word", 2), ("letter", 1), ("letter", 2), ("insert", 1), ("delete", 1)])
def test_like_lines_meet(size, kind, count):
    """Of pairs with an edit similarity of 0.8 or more, whatever their SimHashes, at least 0.9 meet."""
    rng = random.Random(size * 10 + count)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9)))
    met = tried = 0
    for _ in range(150):
        one = " ".join(word() for _ in range(size))
        two = edited(rng, word, one, kind, count)
        if one != two and lines.similar(one, two):
            tried += 1
            taken = lines.Lines(pa.array([one, two]))
            which, keys = lines.block_keys(*taken.units(np.arange(2)))
            met += bool(set(keys[which == 0].tolist()) & set(keys[which == 1].tolist()))
    assert tried and met >= 0.9 * tried


def test_line_dedup_against_all_pairs(spark):
    """Edits of all sorts, at random, up to the limit: links found against edit distance over all pairs."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    texts = []
    for i in range(160):
        n = rng.choice([2, 3, 5, 8, 12, 20, 35, 60])
        line = " ".join(word() for _ in range(n))
        texts.append(line)
        for _ in range(rng.choice([0, 1, 1, 2])):
            for _ in range(rng.randint(1, max(1, n // 10))):
                line = edited(rng, word, line, rng.choice(["word", "letter", "insert", "delete"]), 1)
            texts.append(line)
    texts += ["日本語の長い行はここにあります。同じ行です", "日本語の長い行はここにあります。同じ行だす", "a1", "a2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, found = lines.line_groups(docs)
    component = {r["node"]: r["component"] for r in found.collect()}
    key = lines.Lines(pa.array(texts)).key.tolist()
    label = [component.get(k, k) for k in key]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] != texts[j] and lines.similar(texts[i], texts[j])]
    assert len(pairs) > 120 and sum(label[i] == label[j] for i, j in pairs) >= 0.9 * len(pairs)
    joined = groups(len(texts), lambda i, j: key[i] == key[j] or lines.similar(texts[i], texts[j]))
    assert all(joined[i] == joined[j] for i in range(len(texts)) for j in range(i) if label[i] == label[j])


@pytest.mark.parametrize("hot", [64 << 20, 1])
def test_large_targets_lose_no_line(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT_BYTES", hot)
    texts = [f"the same ten words begin every one of these lines and then {x} {x} ends it" for x in ("here", "there", "nowhere", "hare")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = kept_lines(list(enumerate(texts)), lambda a, b: a == b or lines.similar(a, b))
    assert [r["text"] for r in lines.dedup_lines(docs).orderBy("doc_id").collect()] == want


def test_quality(spark, hard):
    want = []
    for i, t in corpus():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = collections.Counter(three)
        covered = {k + j for k, x in enumerate(three) if many[x] > 1 for j in range(3)}
        real = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        bad = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(real) - len(set(real)), len(covered), bad, not bad))
    got = run(spark, "op7", hard)
    assert counted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in got) == counted(want)


def test_binomial_tail(spark):
    from math import comb

    from pyspark.sql import functions as F

    for k, n, p in ((0, 100, 0.01), (2, 500, 0.02), (7, 40, 0.3)):
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        assert got == pytest.approx(sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))


def test_cutoffs_spare_good_documents(spark, tmp_path):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    rows = [(i, words(60) if i % 5 else "# ".join(words(60).split())) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(4000)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {i for i in range(4000) if i % 5}


def test_substrings(spark, hard):
    seen, want = set(), []
    order = sorted(corpus(), key=lambda r: (r[0] is not None, r[0]))
    for i, t in order:
        b = (t or "").encode()
        hit = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                hit[p : p + 100] = 1
            seen.add(b[p : p + 100])
        gone = hit[: len(b)] > 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = run(spark, "op8", hard)
    assert counted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == counted(want)
    assert substrings.GRAM < 100


@pytest.mark.parametrize(("seed", "bin_bytes"), [(1, 64 << 20), (2, 700)])
def test_substrings_of_random_texts(spark, monkeypatch, seed, bin_bytes):
    """Passages that overlap, repeat within a text, and go on differently, against sets of all strings."""
    monkeypatch.setattr(substrings, "BIN_BYTES", bin_bytes)
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    passages = [letters(rng.randint(60, 260)) for _ in range(8)] + ["ab" * 120]
    texts = [rng.choice(["", letters(30)]) + "".join(rng.choice(passages)[rng.randint(0, 40) :] + letters(rng.choice([0, 0, 1, 20])) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = t.encode()
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                hit[p : p + 100] = True
            seen.add(b[p : p + 100])
        edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(int)))
        want[i] = edges.reshape(-1, 2).tolist()
    rows = substrings.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: [[a, b] for a, b in zip(r["starts"], r["ends"])] for r in rows} == want
    assert sum(map(len, want.values())) > 30


def test_buckets_are_refined_by_their_bytes():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, (300, 21)).astype(np.uint8) * 255
    data[::7] = data[0]
    bucket = rng.integers(0, 4, 300)
    order, common = substrings.refined(bucket, data)
    assert [(bucket[i], bytes(data[i])) for i in order.tolist()] == sorted((b, bytes(x)) for b, x in zip(bucket, data))
    for length in (0, 1, 8, 9, 21):
        got = substrings.pointers(order, common, length)
        names = {}
        for i in range(300):
            names.setdefault((bucket[i], bytes(data[i][:length])), set()).add(int(got[i]))
        assert all(len(x) == 1 for x in names.values()) and len(set.union(*names.values())) == len(names)


def test_licenses(spark, hard):
    got = run(spark, "op10", hard)
    assert [(r["doc_id"], r["licenses"]) for r in got] == [(19, "Apache-2.0,proprietary")]
    mit = "Copyright X.\n" + ". ".join(s[0][0].upper() + s[0][1:] for s in (licenses.SENTENCES[k] for k in ("mit_grant", "mit_notice", "mit_asis"))) + "."
    header = "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. Other words. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 . " + licenses.SENTENCES["apache_asis"][0] + "."
    docs = spark.createDataFrame([(1, mit), (2, header), (3, "MIT licensed things"), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: [(x["license"], x["rule"]) for x in r["licenses"]] for r in licenses.scan(docs).collect()}
    assert found == {1: [("MIT", "text")], 2: [("Apache-2.0", "header")], 3: [], 4: []}


MIT = """MIT License

Copyright (c) 2024 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""


def test_unaltered_license_texts(spark):
    texts = {("MIT", "text"): MIT, ("GPL-3.0-or-later", "header"): GPL, ("Apache-2.0", "header"): APACHE, ("MPL-2.0", "notice"): MPL, ("BSD-2-Clause", "text"): BSD, ("BSD-3-Clause", "text"): "Copyright (c) 2020, Some One\nAll rights reserved.\n\n" + BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""}
    rows, want = [], []
    for rule, text in texts.items():
        forms = [text, "\n\n".join(" ".join(x.split()) for x in text.split("\n\n")), text.replace("\n", "\r\n"), "int x = 1\n" + text + "int y"]
        forms += ["".join(f"{sign} {line}".rstrip() + "\n" for line in text.splitlines()) for sign in ("#", "//", " *", "--", ";;")]
        rows += [(len(want) + i, f) for i, f in enumerate(forms)]
        want += [rule] * len(forms)
    rows += [(1000, "Copyright Some One\nAll rights reserved\nThis project is\nlicensed under the MIT License\nthe end"), (1001, GPL.replace("version 3", "version 2").replace("software:", "software;"))]
    got = {r["doc_id"]: [(x["license"], x["rule"]) for x in r["licenses"]] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(1000) == [("MIT", "notice"), ("proprietary", "notice")] and got.pop(1001) == [("GPL-2.0-or-later", "header")]
    assert got == {i: [rule] for i, rule in enumerate(want)}


def test_one_of_each_keeps_the_smallest(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 8 in ids and not {9, 12, 1000} & set(ids) and ids.count(None) == 1


def shingle_set(text, k=5):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_one_of_each_against_all_pairs(spark):
    rng = random.Random(6)
    texts = ["", None]
    for _ in range(40):
        base = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(rng.choice([6, 40, 100, 300]))]
        texts.append(" ".join(base))
        for _ in range(3):
            changed = set(rng.sample(range(len(base)), rng.choice([1, 1, 2, len(base) // 40 + 1, len(base) // 10 + 1])))
            texts.append(" ".join("new" + str(rng.randrange(99)) if i in changed else w for i, w in enumerate(base)))
    sets = [shingle_set(t) for t in texts]
    label = groups(len(texts), lambda i, j: bool(sets[i] and sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    want = {min(i for i, y in enumerate(label) if y == x) for x in set(label)}
    assert got == want and 40 < len(want) < len(texts) - 30


def test_pipeline(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, hard).collect(), docs.schema)
        assert at.columns == docs.columns
    left = {r["doc_id"] for r in at.collect()}
    assert {6, 7, 8} <= left and not {0, 1, 2, 3, 4, 17, 1000} & left
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, hard).collect()} == left


def test_pipeline_against_brute_force(spark, tmp_path):
    """The stages in plain Python by their criteria alone: every pair of lines, documents, runs."""
    rng = random.Random(9)
    prose = lambda n: ["".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(n)]
    cut = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    base, passage = prose(120), BENCH[0][1].split()
    near, item = [*base], [*passage]
    near[30] = near[90] = "zzz"
    item[11] = item[15] = item[17] = "other"
    extra = [(2000, cut(base, 4)), (2001, cut(near, 7)), (2002, " ".join(prose(40) + item + prose(40)))]
    write(str(tmp_path), corpus() + extra)
    hard = str(tmp_path)
    rows = [(i, t or "") for i, t in corpus() + extra]

    def good(t):
        w = t.split()
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = collections.Counter(three)
        return len(w) >= 50 and 2 * len({k + j for k, x in enumerate(three) if many[x] > 1 for j in range(3)}) <= len(w)

    rows = sorted(((i, t) for i, t in rows if good(t)), key=lambda r: (r[0] is not None, r[0]))
    norm = lambda x: " ".join(re.sub("[^a-z0-9\x80-\U0010ffff]", " ", x.lower()).split())
    texts = kept_lines(rows, lambda a, b: lines.edit_distance(a, b) <= 0.2 * max(len(a), len(b)))
    rows = [(i, t) for (i, _), t in zip(rows, texts) if t.split()]
    sets = [shingle_set(t) for _, t in rows]
    label = groups(len(rows), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    rows = [r for k, r in enumerate(rows) if label.index(label[k]) == k]

    def holds(t):
        w = norm(t).split()
        for own in (b[1].split() for b in BENCH if b[1]):
            for d in range(-len(own), len(w)):
                same = [own[p - d] == w[p] for p in range(max(d, 0), min(d + len(own), len(w)))]
                if sum(same) >= min(13, -(-4 * len(own) // 5)) and any(
                    5 * sum(same[a:b]) >= 4 * (b - a) and sum(same[a:b]) >= min(13, -(-4 * len(own) // 5)) for a in range(len(same)) for b in range(a, len(same) + 1)
                ):
                    return True
        return False

    want = {i for i, t in rows if not holds(t)}
    assert 2000 in want and not {2001, 2002} & want
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, hard).collect()} == want
