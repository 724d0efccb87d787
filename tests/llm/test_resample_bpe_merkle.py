"""Resampling, BPE and the Merkle manifest against brute force, with nulls, empty, long and repeated texts, ties and clashing columns."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from usagelake.llm import bpe, resample
from usagelake.llm.bpe import Codec, Vocabulary, merged, merged_all, token_count
from usagelake.llm.merkle import Treehash, block_root, folded, joined, leaf, manifest, proof, traversal
from usagelake.llm.queries import op12_bpe
from usagelake.llm.resample import importance_ranks, resampled
from usagelake.llm.slices import sliced

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


# resampling
def brute_ranks(rows, target, max_n, n_buckets, min_words, percent, seed=2024):
    lower = {c: c + 32 for c in range(65, 91)}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    features = lambda w: [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    words = [split(t) for _, t in rows]
    held = [[bucket(f) for f in features(w)] for w in words]
    ours, theirs = Counter(b for h in held for b in h), Counter(bucket(f) for t in target for f in features(split(t)))
    total, aimed = sum(ours.values()), sum(theirs.values())
    gain = {b: math.floor(1000 * math.log((theirs[b] + 1) * (total + n_buckets) / ((ours[b] + 1) * (aimed + n_buckets)))) for b in ours}
    made = []
    for (i, _), w, h in zip(rows, words, held, strict=True):
        weight = sum(gain[b] for b in h) // len(h) if h else 0
        u = (int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        made.append([i, len(h), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, len(w)])
    eligible = sorted((m for m in made if m[5] >= min_words), key=lambda m: (-m[3], m[0] is None, m[0] or 0, m[1], m[2]))
    for rank, m in enumerate(eligible[: percent * len(eligible) // 100], 1):
        m[4] = rank
    return Counter(tuple(m[:5]) for m in made)


def corpus(rng, n):
    texts = [None, "", "  ,, ", "É È é", "a\x00b A1b", "x" * 50_000, " ".join(f"w{i}" for i in range(30_000))]
    texts += [" ".join(rng.choice(["Alpha", "beta", "gamma7", "δέλτα", "w%d" % rng.randrange(300)]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    ids = [None, None, *range(100, len(texts) + 98)]
    return [*zip(ids, texts, strict=True), (100, texts[2]), (200, texts[102]), (200, texts[102]), (None, texts[50]), (None, texts[50])]


@pytest.mark.parametrize(("max_n", "n_buckets", "percent"), [(1, 10_000, 10), (3, 97, 50), (2, 1, 100)])
def test_ranks_equal_a_plain_count(spark, max_n, n_buckets, percent, monkeypatch):
    monkeypatch.setattr(resample, "SLICE", 3000)
    rows, target = corpus(random.Random(3), 300), [None, "", "alpha beta beta", "w1 w2 gamma7 δέλτα"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("Score", F.lit("clash")).withColumn("id", F.lit("clash")).withColumn("counts", F.lit(1))
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_ranks(docs.repartition(5), aims, max_n=max_n, n_buckets=n_buckets, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == brute_ranks(rows, target, max_n, n_buckets, 20, percent)


def test_ranks_of_ties_and_empty_tables(spark):
    alike = [(7, "same words here")] * 40 + [(None, "same words here")] * 9
    docs, none = spark.createDataFrame(alike, "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, text string")
    got = importance_ranks(docs, docs, min_words=1, percent=60).collect()
    assert Counter(map(tuple, got)) == brute_ranks(alike, [t for _, t in alike], 1, 10_000, 1, 60)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 30))
    assert importance_ranks(none, docs).count() == 0
    assert Counter(map(tuple, importance_ranks(docs, none, min_words=1).collect())) == brute_ranks(alike, [], 1, 10_000, 1, 10)
    assert importance_ranks(docs, docs, min_words=4).where("rank is not null").count() == 0


def test_resampled_documents_keep_their_columns(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["cat", "dog"] if i % 10 == 0 else ["tax", "law", "act"]) for _ in range(30)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("rank", F.lit("mine")).withColumn("_drawn", F.col("doc_id"))
    drawn = resampled(docs, spark.createDataFrame([("cat dog dog cat",)], "text string"), percent=5)
    rows = drawn.collect()
    assert drawn.columns == docs.columns and len(rows) == 20 and all(r["rank"] == "mine" for r in rows)
    assert sum(r.doc_id % 10 == 0 for r in rows) > 10


# slices
def test_slices_hold_all_rows_in_order():
    import pyarrow as pa

    texts = [None, "", "a" * 10, "b" * 3, "é" * 2, None, "c" * 100, "d"]
    batches = [pa.RecordBatch.from_pydict({"t": texts[:5], "i": range(5)}), pa.RecordBatch.from_pydict({"t": texts[5:], "i": range(5, 8)})]
    got = list(sliced(iter(batches), "t", 8))
    assert [x for b in got for x in b["t"].to_pylist()] == texts and [x for b in got for x in b["i"].to_pylist()] == list(range(8))
    assert all(b.num_rows == 1 or sum(len((t or "").encode()) for t in b["t"].to_pylist()) <= 8 for b in got)


# BPE
@pytest.fixture(scope="module")
def codec():
    with open(BPE_FILE, encoding="utf-8") as file:
        return Codec(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE_FILE)


def as_library(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    packed = codec.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == want, text[:80]
    assert codec.decode(packed) == library.decode(want, skip_special_tokens=False) == text


def test_merged_takes_the_leftmost_lowest_rank():
    rng = random.Random(5)
    for _ in range(300):
        merges, new = {}, 5
        for rank in range(rng.randrange(0, 25)):
            pair = (rng.randrange(new), rng.randrange(new))
            if pair not in merges:
                merges[pair] = (rank, new)
                new += 1
        symbols = [rng.randrange(5) for _ in range(rng.randrange(0, 40))]
        want = list(symbols)
        while any(p in merges for p in zip(want, want[1:], strict=False)):
            _, at = min((merges[p][0], i) for i, p in enumerate(zip(want, want[1:], strict=False)) if p in merges)
            want[at : at + 2] = [merges[want[at], want[at + 1]][1]]
        assert merged(symbols, merges) == want
        codes = sorted((a << 32 | b, rank) for (a, b), (rank, _) in merges.items()) or [(-1, 0)]
        wide, becomes = np.full((3, 64), -1), np.array([dict(merges.values()).get(rank, -1) for rank in range(25)])
        wide[1, : len(symbols)] = symbols
        done = merged_all(wide, np.array([0, len(symbols), 0]), np.array([c for c, _ in codes]), np.array([r for _, r in codes]), becomes)
        assert [x for x in done[1].tolist() if x >= 0] == want and (done[[0, 2]] == -1).all()


def test_every_code_point_encodes_as_in_the_library(codec, library):
    for start in range(0, 0x110000, 4096):
        points = [chr(p) for p in range(start, start + 4096) if not 0xD800 <= p < 0xE000]
        as_library(codec, library, "".join(f"a{c} {c}1 {c}{c}." for c in points))


def test_texts_encode_as_in_the_library(codec, library, monkeypatch):
    rng = random.Random(6)
    letters = [*"aàb c  '\n\t\r.1²ſⅧ日本語é’\x85\x1c​　\x00", "<|endoftext|>", "<|endoftext", "'s", "'re", " the", " hello", "  "]
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(bpe, "CHUNK", chunk)
        for _ in range(1500):
            as_library(codec, library, "".join(rng.choice(letters) for _ in range(rng.randrange(60))))
        as_library(codec, library, "".join(rng.choice("abcdefgh") for _ in range(20_000)) + " " * 3000 + "a" * 20_000)
        as_library(codec, library, " ".join(f"w{rng.randrange(9999)}" for _ in range(20_000)))


def test_codec_refuses_what_it_cannot_do(codec):
    with open(BPE_FILE, encoding="utf-8") as file:
        made = json.load(file)
    for where, value in ((("pre_tokenizer", "add_prefix_space"), True), (("model", "type"), "Unigram"), (("model", "dropout"), 0.1)):
        other = json.loads(json.dumps({**made, "model": {**made["model"], "merges": made["model"]["merges"][:5]}}))
        other[where[0]][where[1]] = value
        with pytest.raises(ValueError, match="byte-level"):
            Codec(json.dumps(other))
    with pytest.raises(ValueError, match="99999999"):
        codec.decode(np.array([99999999], "<u4").tobytes())


def test_vocabulary_columns(spark, library):
    rows = [(1, None), (1, ""), (2, "Hello  world<|endoftext|>'s"), (2, "Hello  world<|endoftext|>'s"), (3, "long " * 200_000), (None, "x")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    vocabulary = Vocabulary(spark, BPE_FILE)
    packed = table.select("*", vocabulary.encode(F.col("text")).alias("packed"))
    got = packed.select("*", token_count(F.col("packed")).alias("n"), vocabulary.decode(F.col("packed")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.packed), "<u4").tolist() == want and r.n == len(want) and r.back == (r.text or "") and r.ids == "clash"
    assert spark.createDataFrame([], DOCS).select(vocabulary.encode(F.col("text"))).count() == 0


def test_op12_equals_the_library_on_whole_documents(spark, library):
    path = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[r.doc_id] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op12_bpe(spark, path).collect()} == want


# Merkle manifest
def tree_of(leaves):
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([joined(*found[-1][i : i + 2]) for i in range(0, len(found[-1]), 2)])
    return found


def sibling(tree, height, at):
    other = (at >> height) ^ 1
    return tree[height][other] if other < len(tree[height]) else None


def test_traversal_equals_the_whole_tree_and_holds_few_nodes(monkeypatch):
    most = 0
    step = Treehash.step

    def counted(self):
        nonlocal most
        step(self)
        most = max(most, len(self.stack))

    monkeypatch.setattr(Treehash, "step", counted)
    for n in [*range(1, 40), 64, 100, 129]:
        leaves = [joined(str(i)) for i in range(n)]
        tree, height = tree_of(leaves), (n - 1).bit_length()
        assert block_root(leaves, height) == tree[-1][0]
        for at, path in enumerate(traversal(leaves, height)):
            assert path == [sibling(tree, h, at) for h in range(height)]
    assert most <= 9


def plain_leaf(values):
    parts = [b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in values]
    return hashlib.sha256(b"".join(parts)).hexdigest()


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_manifest_equals_plain_trees(spark, bits):
    rng = random.Random(7)
    rows = [(i, f"t{i}é" * rng.randrange(4), rng.choice(["de", "en", None, "", "ü"]), "s", i * 3 if i % 4 else None) for i in rng.sample(range(-50, 1000), 150)]
    rows += [(5000, "only", "zz", None, 1), (None, None, "en", None, None), (None, "b", "en", "s", 1), (7777, "twice", "en", "s", 2), (7777, "twice", "en", "s", 2), (7778, "x" * 300_000, None, "s", 2)]
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    table = spark.createDataFrame(rows, DOCS).withColumn("pos", F.lit("clash")).withColumn("tree", F.lit("clash")).withColumn("Node", F.lit("clash"))
    got = manifest(table.repartition(3), "doc_id", "lang", fields, keep={"chars": F.col("n_chars"), "lang": F.col("lang")}, bits=bits)
    made = [(r[2], r[0], plain_leaf([r[0], r[3], r[2], r[4], r[1]])) for r in rows]
    langs = sorted({lang for lang, _, _ in made}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree_of([h for _, h in sorted(((i is not None, i or 0), h) for lang, i, h in made if lang == x)]) for x in langs}
    top = tree_of([trees[x][-1][0] for x in langs])
    want = Counter()
    for place, lang in enumerate(langs):
        keyed = sorted(((i is not None, i or 0), h, i) for x, i, h in made if x == lang)
        for at, (_, h, i) in enumerate(keyed):
            path = [sibling(trees[lang], k, at) for k in range(len(trees[lang]) - 1)] + [sibling(top, k, place) for k in range(len(top) - 1)]
            want[i, lang, at, h, trees[lang][-1][0], top[-1][0], tuple(x or "" for x in path)] += 1
    rows = got.withColumn("folded", folded(F.col("leaf"), F.col("sides"), F.col("siblings"))).withColumn("proof", proof(F.col("siblings"))).collect()
    assert Counter((r.doc_id, r.lang, r.position, r.leaf, r.subroot, r.root, tuple(r.siblings)) for r in rows) == want
    assert all(r.folded == r.root and r.proof == hashlib.sha256("".join(r.siblings).encode()).hexdigest() for r in rows)


def test_manifest_of_one_row_none_and_an_altered_leaf(spark):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    assert manifest(spark.createDataFrame([], DOCS), "doc_id", "lang", fields).count() == 0
    one = manifest(spark.createDataFrame([(1, "t", None, None, None)], DOCS), "doc_id", "lang", fields).collect()[0]
    assert one.leaf == one.subroot == one.root == plain_leaf([1, None, None, None, "t"]) and one.sides == "" and one.siblings == []
    table = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(37)], DOCS)
    altered = leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])
    rows = manifest(table, "doc_id", "lang", fields, keep={"altered": altered}).withColumn("folded", folded(F.col("altered"), F.col("sides"), F.col("siblings"))).collect()
    assert len(rows) == 37 and all(r.folded != r.root for r in rows)
