"""The training-data operators against brute force, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import html as html_module
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelake.llm.decontaminate import Index, aligned, contaminated, decontaminated, parts_of
from usagelake.llm.graph import connected_components
from usagelake.llm.html_text import extract_text, main_text
from usagelake.llm.line_dedup import simhash, without_repeated_lines
from usagelake.llm.mixing import mixed_counts, mixed_documents, mixture
from usagelake.llm.near_dedup import deduplicated, near_duplicates
from usagelake.llm.quality import fit_quality, fit_rules, score_quality, statistics
from usagelake.llm.sharding import assign_shards
from usagelake.llm.suffix_dedup import PrefixHashes, remove_repeated, suffix_order
from usagelake.llm.toxicity import Network, Scorer, fit_toxicity, score_toxicity, sigmoid, train, windows
from usagelake.llm.vector_search import top_k

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, sources=None, ids=None):
    rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else "a", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# sharding
def test_sharding_is_gapless_stable_and_moves_only_into_the_new_shard(spark):
    rng = random.Random(1)
    texts = [None, "", "é" * 5] + [words(rng, 5) for _ in range(300)] + ["same"] * 50
    ids = [None, None] + list(range(len(texts) - 4)) + [7, 7]
    table = docs(spark, texts, ids=ids).withColumn("Slot", F.lit("clash"))
    rows = assign_shards(table).collect()
    assert len(rows) == len(texts) and sorted(c for c in rows[0].asDict() if c.lower() == "slot") == ["slot"]
    for shard in range(16):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(r.grown_shard in (r.shard, 16) for r in rows) and any(r.grown_shard == 16 for r in rows)
    assert all(r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in rows)
    again = {(r.doc_id, r.text): r.shard for r in assign_shards(table.repartition(3)).collect()}
    assert all(again[r.doc_id, r.text] == r.shard for r in rows)
    heavy = Counter(r.shard for r in assign_shards(docs(spark, ["x"] * 3000), weights=(1.0, 3.0)).collect())
    assert 0.68 < heavy[1] / 3000 < 0.82
    assert assign_shards(docs(spark, [])).count() == 0
    with pytest.raises(ValueError, match="weight"):
        assign_shards(table, weights=(0.0,))


def test_sharding_equals_a_second_rendezvous(spark):
    rng = random.Random(21)
    ids, texts = [None, 5, 5, *range(100, 220)], ["x", "y", "z", *(words(rng, 4) for _ in range(120))]
    rows = assign_shards(docs(spark, texts, ids=ids)).select("doc_id", "text", "size", "text_crc32", "shard", "slot", "grown_shard").collect()

    def bid(i, shard):
        digest = hashlib.md5(f"shard:{'null' if i is None else f'k{i}'}:{shard}".encode()).hexdigest()
        return -math.log((int(digest[:13], 16) + 0.5) / 2**52)

    want = {}
    for i, t in zip(ids, texts, strict=True):
        size, crc = len(t.encode()) + 1, zlib.crc32(t.encode())
        place = hashlib.md5(f"shard:{'null' if i is None else f'k{i}'}:{crc}:{size}".encode()).hexdigest()
        want[i, t] = (size, crc, min(range(16), key=lambda s: bid(i, s)), min(range(17), key=lambda s: bid(i, s)), place)
    slots = {k: sorted(v[4] for v in want.values() if v[2] == want[k][2]).index(want[k][4]) for k in want}
    assert {(r.doc_id, r.text): (r.size, r.text_crc32, r.shard, r.grown_shard, r.slot) for r in rows} == {k: (*v[:4], slots[k]) for k, v in want.items()}


# mixing
def filled(sizes, weights, budget):
    target, open_ = {}, dict(sizes)
    left = budget * sum(sizes.values())
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    names = ["b", "a", "zz", None, "c", "é"]
    sources = [rng.choice(names[:1] * 5 + names) for _ in range(400)]
    texts = [None if i == 3 else "" if i == 4 else words(rng, rng.randrange(1, 60)) for i in range(400)]
    table = docs(spark, texts + texts[:20], sources + sources[:20])
    table = table.withColumn("size", F.lit("clash"))
    rows = mixed_counts(table, block_words=64).collect()
    assert len(rows) == 420
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for s, t in zip(sources + sources[:20], texts + texts[:20], strict=True):
        total[s] += size(t)
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = filled(total, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5)
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        s = next(x for x in total if total[x] == r.source_size and abs(want[x] - r.target) < 1e-6)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 * 64 for s in total)  # whole blocks, and points of low discrepancy
    assert sorted(map(str, rows)) == sorted(map(str, mixed_counts(table.repartition(5), block_words=64).collect()))
    assert mixed_counts(docs(spark, [])).count() == 0 and mixed_counts(docs(spark, ["", None])).count() == 2


def brute_mix(sources, words_of, block):
    """Slots of each source by the golden-ratio points, one after the other."""
    total, cumulative, at = sum(words_of.values()), [], 0.0
    for s in sources:
        at += words_of[s]
        cumulative.append(int(at / total * 2**31))
    slots = Counter()
    for n in range(-(-sum(round(w) for w in words_of.values()) // block)):
        point = (n + 1) * 1327217885 % 2**31
        slots[next(s for s, upto in zip(sources, cumulative, strict=True) if point < upto)] += 1
    return slots


def test_mixing_takes_what_the_schedule_says(spark, monkeypatch):
    from usagelake.llm import mixing

    rng = random.Random(3)
    table = docs(spark, [words(rng, 30) for _ in range(200)], [rng.choice("aab") for _ in range(200)])
    mix = mixture(table, block_words=100)
    size = {s.source_key: s.source_size for s in mix.sources.collect()}
    target = {s.source_key: s.target for s in mix.sources.collect()}
    slots = brute_mix(["sa", "sb"], target, 100)
    assert {s.source_key: s.slots for s in mix.sources.collect()} == slots
    blocks = {(b.source_key, b.block): b.slot for b in mix.schedule.collect()}
    assert all([blocks[s, k] for k in range(n)] == sorted(blocks[s, k] for k in range(n)) for s, n in slots.items()) and len(blocks) == sum(slots.values())
    pieces = mix.pieces.groupBy("source_key", "slot").agg(F.sum("n_words").alias("n")).collect()
    assert Counter({s: sum(p.n for p in pieces if p.source_key == s) for s in size}) == {s: min(2 * size[s], 100 * slots[s]) for s in size}
    assert sum(p.n != 100 for p in pieces) <= 2
    copies = mixed_documents(table, block_words=100)
    assert copies.columns == table.columns
    counts = Counter(r.source for r in copies.collect())
    assert {s: counts[s[1:]] for s in size} == {s: -(-min(2 * size[s], 100 * slots[s]) // 30) for s in size}
    # Points that are not spread give another mix.
    taken = lambda: sorted((r.doc_id, r.taken) for r in mixed_counts(table, block_words=100).collect())
    as_dealt = taken()
    monkeypatch.setattr(mixing, "STEP", 1)
    assert taken() != as_dealt


# near duplicates
def brute_components(texts, ids, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * len(sets[i] | sets[j]):
            comp[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[find(i)], least[find(i)] == ids[i]) for i in range(len(texts))}


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, num, monkeypatch):
    from usagelake.llm import near_dedup

    monkeypatch.setattr(near_dedup, "FAMILY", 20)  # so that the chunks of large families come into play
    monkeypatch.setattr(near_dedup, "NODE", 12)
    rng = random.Random(k)
    texts = [None, "", " \t\n", "one", "One", "one two", words(rng, 3000)]
    for _ in range(12):
        t = words(rng, 120).split()
        texts += [" ".join(t)] * 2
        for n in (1, 2, 3, 4, 6, 9):
            u = list(t)
            for _ in range(n):
                u[rng.randrange(len(u))] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(u))
    base = words(rng, 200).split()
    for i in range(60):
        u = list(base)
        for _ in range(1 + i % 4):
            u[rng.randrange(len(u))] = f"v{rng.randrange(9999)}"
        texts.append(" ".join(u).upper() if i % 5 == 0 else " ".join(u))
    ids = [i * 3 for i in range(len(texts))]
    rng.shuffle(ids)
    table = docs(spark, texts, ids=ids).withColumn("component_id", F.lit("clash"))
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(table, size=k, num=num).collect()}
    # V and v differ: only A-Z are lower-cased, so upper-cased words agree again.
    assert found == brute_components(texts, ids, k, num, 100)
    kept = deduplicated(table, size=k, num=num)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, v in found.items() if v[2]}


def test_near_duplicates_of_odd_tables(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    rows = near_duplicates(docs(spark, ["a b c d e f"] * 3 + [None], ids=[None, 5, 5, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]


def test_near_duplicates_where_ids_repeat(spark):
    """One id with two texts in different partitions, and many rows without an id."""
    rng = random.Random(22)
    one, two = words(rng, 60).split(), words(rng, 60).split()
    near = lambda t, k: " ".join([*t[:k], "changed", *t[k + 1 :]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one, 59)), (3, near(two, 0))] + [(None, words(rng, 30)) for _ in range(40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_duplicates(table).collect() if r.doc_id)
    assert found == [("1", 56, "1"), ("1", 56, "1"), ("2", 56, "1"), ("3", 56, "1")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, j) for j in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert found == {i: 0 for i in range(31)} | {j: 100 for j in range(100, 140)} | {200: 200, 201: 200}


# suffixes
def test_suffix_order_sorts_groups():
    rng = random.Random(4)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12))) for _ in range(200)]
    group = np.sort(np.array([rng.randrange(20) for _ in parts]))
    data = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
    size = np.array([len(p) for p in parts])
    start = np.cumsum(size) - size
    order = suffix_order(data, PrefixHashes(data, 0x9E3779B97F4A7C15), start, size, group)
    assert order.tolist() == sorted(range(200), key=lambda i: (group[i], parts[i], i))


def brute_removed(texts, length=400):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group", [64, 2])
def test_suffix_dedup_equals_brute_force(spark, group, monkeypatch):
    from usagelake.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1500)
    rng = random.Random(5)
    passage, other = words(rng, 150), words(rng, 90)
    texts = [None, "", "x" * 399, "ab" * 700, words(rng, 200), words(rng, 200)]
    texts += [words(rng, rng.randrange(0, 40)) + passage[rng.randrange(30) :] + words(rng, 20) for _ in range(12)]
    texts += ["é" + other + words(rng, 5), other[3:420] + "z", other[:399]]
    texts += [texts[4]] + [texts[5][:300] + "!" + texts[5][301:]]
    found = remove_repeated(docs(spark, texts, ids=[i // 2 for i in range(len(texts))])).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute_removed(texts)
    assert remove_repeated(docs(spark, [])).count() == 0


# lines
def test_simhash_counts_bits(spark):
    rng = random.Random(6)
    line = [f"w{rng.randrange(50)}" for _ in range(700)]
    df = spark.createDataFrame([(line,)], "w array<string>")
    row = df.select(simhash(F.col("w")).alias("s"), F.transform("w", lambda x: F.xxhash64(x)).alias("h")).first()
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in row.h) > len(line))
    assert row.s % 2**64 == want


def test_line_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(7)
    long = words(rng, 60).split()
    near = list(long)
    near[5] = "changed"
    texts = ["first line here is kept\nshort\n" + " ".join(long), "FIRST line, here is kept!\nshort\nother words stand in this one", None, "", " ".join(near) + "\n\n" + " ".join(long), words(rng, 60)]
    rows = {r.doc_id: r for r in without_repeated_lines(docs(spark, texts).withColumn("line", F.lit(1))).collect()}
    assert rows[0].text == texts[0] and rows[1].text == "short\nother words stand in this one" and rows[1].n_removed == 1
    assert rows[2].text == "" and rows[3].text == "" and rows[5].n_removed == 0
    assert rows[4].text in ("\n".join([" ".join(near), ""]), "")  # a one-word edit may lie beyond three bits
    assert without_repeated_lines(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [64, 3])
def test_line_dedup_links_what_is_near_in_bits_and_words(spark, bucket, monkeypatch):
    from usagelake.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    rng = random.Random(8)
    lines = []
    for _ in range(6):
        base = words(rng, 80, 5000).split()
        for _ in range(12):
            u = list(base)
            u[rng.randrange(80)] = f"edit{rng.randrange(9)}"
            lines.append(" ".join(u))
    table = docs(spark, lines)
    classes = table.select(F.col("doc_id").alias("class"), F.struct("doc_id", F.xxhash64("text").alias("key"), F.lit(0).alias("number")).alias("one"), line_dedup.code_of(F.split("text", " ")).alias("code"))
    code = {r["class"]: r.code for r in classes.collect()}
    found = {frozenset((r.a, r.b)) for r in line_dedup.line_links(table.select("doc_id", "text"), classes, 0.8).collect()}
    want = {frozenset((i, j)) for i, j in itertools.combinations(range(len(lines)), 2) if bin((code[i] ^ code[j]) % 2**64).count("1") <= 3 and i // 12 == j // 12}
    comps = lambda edges: sorted(map(sorted, joined(edges)))
    assert comps(found) == comps(want)


def word_edits(x, y):
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != q))
    return row[-1]


@pytest.mark.parametrize("bucket", [64, 2])
def test_line_dedup_finds_all_lines_at_the_similarity(spark, bucket, monkeypatch):
    from usagelake.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SHARED", bucket)
    rng = random.Random(14)
    lines = []
    for n in (5, 6, 10, 14, 20, 33, 60):
        for _ in range(3):
            group = [words(rng, n, 60).split()]
            for _ in range(4):
                u = list(rng.choice(group))
                for _ in range(rng.randrange(1, n // 5 + 2)):
                    at = rng.randrange(len(u))
                    u[at : at + rng.randrange(2)] = [f"w{rng.randrange(60)}"] * rng.randrange(2)
                group += [u] * (len(u) >= 5)
            lines += group
    lines += [["a"] * 5, ["a"] * 4 + ["b"], ["a"] * 6, ["c", "d"] * 10, ["c", "d"] * 9 + ["c"]]
    links = {frozenset((i, j)) for i, j in itertools.combinations(range(len(lines)), 2) if 5 * word_edits(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j]))}
    gone = {i for group in joined(links) for i in group if i != min(group)}
    rows = without_repeated_lines(docs(spark, [" ".join(u) for u in lines])).collect()
    assert {r.doc_id for r in rows if r.n_removed} == gone and len(gone) > 30


@pytest.mark.parametrize("by", ["words", "bits"])
def test_line_dedup_links_classes_closed_by_different_pivots(spark, by, monkeypatch):
    from usagelake.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BUCKET", 2)
    monkeypatch.setattr(line_dedup, "SHARED", 2)
    # Classes 0 and 1 become pivots; 2 closes with 0, 3 with 1, and only the link of 2 and 3 joins all four.
    chain = [0, 2, 3, 1]
    lines, code, row = {}, {}, "a b c d e f g h i j".split()
    for k, c in enumerate(chain):
        lines[c], code[c] = " ".join(row), (1 << 3 * k) - 1
        row[2 * k : 2 * k + 2] = [f"x{k}", f"y{k}"]
    table = docs(spark, [lines[c] for c in range(4)])
    where = F.struct("doc_id", F.xxhash64("text").alias("key"), F.lit(0).alias("number")).alias("one")
    codes = F.element_at(F.array(*[F.lit(code[c]).cast("bigint") for c in range(4)]), (F.col("doc_id") + 1).cast("int"))
    keys = F.struct(F.lit(10).alias("n"), F.array(*[F.lit(k).cast("bigint") for k in range(1, 5)]).alias("first"), F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("high"))
    classes = table.select(F.col("doc_id").alias("class"), where, codes.alias("code"), keys.alias("keys"))
    links = (line_dedup.edit_links if by == "words" else line_dedup.line_links)(table.select("doc_id", "text"), classes, 0.8).collect()
    assert [set(g) for g in joined({frozenset((r.a, r.b)) for r in links})] == [{0, 1, 2, 3}]


@pytest.mark.parametrize("shared", [1024, 8])
def test_line_dedup_recall_at_the_threshold(spark, shared, monkeypatch):
    from usagelake.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SHARED", shared)
    rng = random.Random(17)
    # Words as in texts: few frequent ones, many rare ones; each edit puts a new word, and all that are allowed are made.
    zipf = lambda: f"w{int(2000 ** rng.random())}"
    lines, length = [], []
    for n in (4, 5, 10, 20, 40, 80):
        for _ in range(60):
            u = [zipf() for _ in range(n)]
            v = list(u)
            if n == 4:
                v.insert(rng.randrange(5), "one more")
                v = " ".join(v).split()[:5]
            for at in rng.sample(range(n), n // 5):
                v[at] = f"edit{rng.randrange(10**6)}"
            lines += [" ".join(u), " ".join(v)]
            length += [n, n]
    rows = {r.doc_id: r.n_removed for r in without_repeated_lines(docs(spark, lines), min_words=1).collect()}
    pairs = {n: [word_edits(lines[i].split(), lines[i + 1].split()) * 5 <= max(len(lines[i].split()), len(lines[i + 1].split())) for i in range(0, len(lines), 2) if length[i] == n] for n in set(length)}
    found = {n: [rows[i + 1] == 1 for i in range(0, len(lines), 2) if length[i] == n] for n in pairs}
    for n, alike in pairs.items():
        recall = sum(f for f, a in zip(found[n], alike, strict=True) if a) / sum(alike)
        assert sum(alike) >= 10 and (recall == 1 if n < 20 else recall >= 0.9), (n, recall)


def test_line_dedup_of_a_hot_group_keeps_one(spark, monkeypatch):
    from usagelake.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SHARED", 16)
    rng = random.Random(18)
    base = words(rng, 30, 5000).split()
    lines = [" ".join([*base[:k], f"v{i}", *base[k + 1 :]]) for i in range(150) for k in [rng.randrange(30)]]
    # Unrelated lines that share frequent pairs of words, two of them alike.
    other = [f"of the in the on the to the at the {words(rng, 6, 900)}" for _ in range(60)]
    lines += other + [other[7] + " more"]
    table = docs(spark, lines + [lines[3]] * 100, ids=[None if i == 200 else i for i in range(len(lines) + 100)])
    rows = without_repeated_lines(table).collect()
    assert sum(r.n_removed for r in rows) == 149 + 1 + 100 and next(r for r in rows if r.doc_id == 0).n_removed == 0


def test_line_dedup_takes_short_and_unspaced_lines(spark, tmp_path):
    from usagelake.llm.queries import op4_line_dedup

    han = "".join(chr(0x4E00 + 7 * k) for k in range(30))
    texts = ["All rights reserved\nok\n\n---", "all rights reserved.\nOK\n\n---", han, han[:10] + "\u4e01" + han[11:], "all rights preserved"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.n_removed for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert rows == {0: 0, 1: 2, 2: 0, 3: 1, 4: 0}


def joined(edges):
    groups = []
    for e in edges:
        hit = [g for g in groups if g & e]
        groups = [g for g in groups if not g & e] + [set(e).union(*hit)]
    return groups


# benchmark
def test_decontamination_finds_items_and_leaves_the_rest(spark):
    rng = random.Random(9)
    items = [words(rng, 40) for _ in range(30)] + [words(rng, 20) + "? " + words(rng, 6), None, "", words(rng, 300)]
    texts = [words(rng, 500) for _ in range(40)] + [None, ""]
    held = {}
    for d, i in ((3, 0), (7, 5), (8, 30), (11, 33)):
        w = texts[d].split()
        at = rng.randrange(400)
        texts[d] = " ".join(w[:at]) + ". " + items[i].upper() + ", " + " ".join(w[at:])
        held[d] = i
    half = items[2].split()
    texts[20] += " " + " ".join(half[:15])  # a part of an item isn't the item
    table, bench = docs(spark, texts).withColumn("_hits_0", F.lit(1)), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = contaminated(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == set(held.items())
    kept = decontaminated(docs(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(42)) - set(held) and kept.columns == DOCS.replace(" bigint", "").replace(" string", "").split(", ")
    assert contaminated(table, bench.limit(0)).count() == 0


def test_blocks_of_the_benchmark_don_t_change_hits(spark, monkeypatch):
    from usagelake.llm import decontaminate

    rng = random.Random(23)
    items = [words(rng, 30, 300) for _ in range(12)]
    texts = [words(rng, 80, 300) + " " + items[i] + " " + words(rng, 40, 300) for i in range(6)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    table = docs(spark, texts + texts[:1]).withColumn("_hits", F.lit(7)).withColumn("hits", F.lit(8)).withColumn("row", F.lit(9))
    once = sorted(map(str, contaminated(table, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 900)
    assert sorted(map(str, contaminated(table, bench).collect())) == once and len(once) == 7
    clean = table.unionByName(table.limit(1).withColumn("text", F.lit("nothing of it here")))
    kept = decontaminated(clean, bench)
    assert kept.columns == table.columns and [(r.text, r._hits, r.hits, r.row) for r in kept.collect()] == [("nothing of it here", 7, 8, 9)]


def test_hits_equal_plain_search():
    """All passages by plain BM25 scores of all segments, each verified: the same hits as through ranges and block-max WAND."""
    rng = random.Random(24)
    items = [parts_of(words(rng, n, 200)) for n in (20, 30, 60, 90, 150, 10, 25) for _ in range(6)]
    index = Index.build(items)
    for _ in range(12):
        text = words(rng, 100, 200).split()
        for i in rng.sample(range(len(items)), 3):
            own = [w.decode() for w in items[i][0]]
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] = "edited"
            at = rng.randrange(len(text))
            text[at:at] = own
        tokens, best = " ".join(text).encode().split(), {}
        for start in range(0, max(1, len(tokens) - 32), 32):
            bag = {index.terms[w] for w in tokens[start : start + 64] if w in index.terms}
            for segment in range(len(index.of)):
                score = sum(w for t in bag for s, w in zip(index.postings[t], index.weights[t], strict=True) if s == segment)
                if score >= 0.5 - 1e-9:
                    index.verify(best, tokens, start, segment, score, 0.8, 5)
        want = [best[i] for i in sorted(best)]
        got = index.hits(" ".join(text), 0.5, 0.8, 5)
        assert [(h[0], h[2], h[3]) for h in got] == [(h[0], h[2], h[3]) for h in want] and np.allclose([h[1] for h in got], [h[1] for h in want])


def test_alignment_equals_edit_distance():
    rng = random.Random(15)
    for _ in range(200):
        part, around = (words(rng, rng.randrange(1, n), 6).encode().split() for n in (70, 40))
        want = min(word_edits(part, around[i:j]) for i in range(len(around) + 1) for j in range(i, len(around) + 1)) if len(around) < 12 else None
        assert want is None or aligned(part, around) == 1 - want / len(part)


def test_decontamination_finds_edited_and_partial_items(spark):
    rng = random.Random(16)
    items = [words(rng, n, 5000) for n in (20, 20, 50)] + [words(rng, 300, 5000), words(rng, 300, 5000), words(rng, 20, 5000) + "? " + words(rng, 8, 5000)]
    kept = [i.replace("?", "").split() for i in items]
    kept[0][9] = kept[1][4] = kept[1][14] = "changed"
    kept[2][10] = kept[2][25] = kept[2][40] = "changed"
    kept[3], kept[4], kept[5] = kept[3][86:128], kept[4][100:160], kept[5][:20]
    texts = [f"{words(rng, 200, 5000)} {' '.join(k)} {words(rng, 200, 5000)}" for k in kept] + [words(rng, 400, 5000) + " " + " ".join(items[0].split()[:8])]
    texts[3] = texts[3].replace(" ".join(kept[3]), " ".join(items[3].split()[80:135]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in contaminated(docs(spark, texts), bench).collect()) == [(i, i) for i in range(6)]


def test_wand_returns_all_at_or_above_the_threshold():
    rng = random.Random(10)
    index = Index.build([parts_of(words(rng, 30, 60)) for _ in range(300)])
    for _ in range(60):
        terms = sorted({index.terms[w] for w in words(rng, 40, 60).encode().split() if w in index.terms})
        score = Counter()
        for t in terms:
            for s, x in zip(index.postings[t], index.weights[t], strict=True):
                score[s] += x
        for low, high in ((0, len(index.of)), (40, 170)):
            want = {s: x for s, x in score.items() if x >= 0.55 and low <= s < high}
            got = dict(index.search(terms, 0.55, low, high))
            assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in got)


# pages
PAGE = "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class=\"ad\">Buy now, this is a long advert with many words in it.</div>{main}<aside>Side</aside><div id='comments'><p>First! A reader writes a long comment here.</p></div><form>Name</form><footer>&copy; me</footer></body></html>"


@pytest.mark.parametrize(
    ("main", "want"),
    [
        ("<article><h1>Head</h1><p>One &amp; two<br> three.<p>Next &eacute; <b>bold</b>text.</article>", "Head\n\nOne & two three.\n\nNext é boldtext."),
        ("<article><p>Only.</p></article>", "Only."),
        ("<div class='content'><h2>A title here</h2><div><p>A first paragraph of some length, with words.</p><p>A second paragraph of some length.</p></div></div>", None),
        ("<main><header><h1>Head</h1></header><p>Text of it.</p><div class=share-buttons><a href=x>Share</a></div></main>", "Text of it."),
        ("<p>A bare paragraph in the body, of some length.</p><p>Another one here.</p>", "A bare paragraph in the body, of some length.\n\nAnother one here."),
    ],
)
def test_main_text(main, want):
    found = main_text(PAGE.format(main=main))
    assert not any(x in found for x in ("Menu", "Buy now", "Side", "First!", "Name", "©", "var t"))
    if want:
        assert found.endswith(want)
    else:
        assert "A first paragraph" in found and "A second paragraph" in found


@pytest.mark.parametrize(
    "start",
    ["<div style='overflow:hidden'>", "<div title='hidden gems'>", "<div data-id='ad'>", "<div class='content has-sidebar'>", "<div class=no-sidebar>", "<div class='post-with-comments'>", "<div class='ad-free'>", "<div class=widget>"],
)
def test_names_in_other_attributes_and_around_articles_cut_nothing(start):
    page = PAGE.format(main=start + "<h1>Head</h1><p>A first paragraph of some length, with many words in it.</p><p>A second paragraph of some length, with more.</p></div>")
    found = main_text(page)
    assert "A first paragraph" in found and "A second paragraph" in found and not any(x in found for x in ("Menu", "Buy now", "First!"))


def test_link_lists_of_the_article_stay():
    links = "<ul><li><a href=x>First linked item</a></li><li><a href=y>Second linked item</a></li></ul><table><tr><td><a href=z>Cell</a></td></tr></table><div><a href=w>Linked line.</a></div>"
    page = PAGE.format(main="<article><h1>Head</h1><p>Text of it, of some length.</p>" + links + "</article>")
    assert main_text(page) == "Head\n\nText of it, of some length.\n\nFirst linked item\n\nSecond linked item\n\nCell\n\nLinked line."


@pytest.mark.parametrize(("name", "cut"), [("related-work", False), ("comment-analysis", False), ("share-price", False), ("related-posts", True), ("ad-slot-3", True), ("top-banner", True), ("share-buttons", True), ("notice", True)])
def test_names_of_parts_of_the_article(name, cut):
    page = PAGE.format(main=f"<article><h1>Head</h1><p>Text of it, of some length.</p><section class='{name}'><p>A paragraph in a section.</p></section><p>Last one.</p></article>")
    assert main_text(page) == "\n\n".join(["Head", "Text of it, of some length.", *["A paragraph in a section."] * (not cut), "Last one."])


@pytest.mark.parametrize("name", ["id=skip", "class=social", "class='social widget'", "id=related", "class=share", "class=reply"])
def test_names_that_sections_of_an_article_have_too(name):
    article = "<article><h1>Head</h1><p>Text of it, of some length.</p>{}<p>Last one.</p></article>"
    told = f"<section {name}><h2>Skipping</h2><p>A paragraph with <a href=x>a link</a> in a section.</p></section>"
    assert main_text(PAGE.format(main=article.format(told))) == "Head\n\nText of it, of some length.\n\nSkipping\n\nA paragraph with a link in a section.\n\nLast one."
    nested = f"<section {name}><div class=skip><p>An inner paragraph.</p></div><div class=share><a href=x>Send</a></div></section>"
    assert main_text(PAGE.format(main=article.format(nested))) == "Head\n\nText of it, of some length.\n\nAn inner paragraph.\n\nLast one."
    for links in ("<a href=x>Send</a> <a href=y>Post</a>", "<p><a href=x>Send to a friend</a> or <a href=y>post it</a></p>", "<button>Like</button>"):
        assert main_text(PAGE.format(main=article.format(f"<div {name}>{links}</div>"))) == "Head\n\nText of it, of some length.\n\nLast one."


def test_hidden_elements_stay_cut():
    assert main_text(PAGE.format(main="<article><p>Text of it.</p><div hidden>x</div><div aria-hidden=true>y</div><p role='alert'>z</p><p class='ad-slot'>q</p></article>")) == "Text of it."


def test_extraction_of_odd_pages(spark):
    pages = [None, "", "plain text", "<p>unclosed", "<<<>", "<div" * 3000 + ">x", "<p>" + "long word " * 50_000, "<b><i>" * 5000 + "deep", "a &am &amp &#x41; b", "<!-- open", "<p class=\"a>b\">q</p>"]
    table = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages + pages)], "page_id bigint, url string, html string").withColumn("Text", F.lit("clash"))
    rows = extract_text(table).collect()
    assert len(rows) == 2 * len(pages) and all(r.n_chars == len(r.text) for r in rows)
    text = {r.page_id: r.text for r in rows}
    assert (text[0], text[1], text[2], text[3], text[8], text[10]) == ("", "", "plain text", "unclosed", html_module.unescape("a &am &amp &#x41; b"), "q")
    assert text[6] == ("long word " * 50_000).strip() and text[7] == "deep"
    assert extract_text(table.limit(0)).count() == 0


# vectors
def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    vectors = [rng.normal(size=6).tolist() for _ in range(300)]
    vectors[5] = vectors[0]
    vectors += [None, [1.0, None] + [0.0] * 4, [float("nan")] + [0.0] * 5, [float("inf")] * 6, [], [1.0, 2.0], [3.0, 4.0], [0.0] * 6] + [[0.25] * 6] * 30
    ids = list(range(len(vectors) - 4)) + [None, 0, 50, 50]
    table = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    rows = top_k(table.repartition(3), F.col("vec_id") % 50 == 0, 5).collect()
    ints = [None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(256 * x)) for x in v] for v in vectors]
    want = []
    for i, q in enumerate(ints):
        if q is None or ids[i] is None or ids[i] % 50:
            continue
        near = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), ids[j] if ids[j] is not None else 2**63, j) for j, v in enumerate(ints) if v is not None and j != i and len(v) == len(q))
        want += [(ids[i], rank + 1, ids[j], -s) for rank, (s, _, j) in enumerate(near[:5])]
    assert sorted((r.query_id, r["rank"], str(r.vec_id), r.score) for r in rows) == sorted((a, b, str(c), d) for a, b, c, d in want)
    assert top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# classifiers
def labelled(spark, n=900):
    rng = random.Random(12)
    texts, y, t = [], [], []
    for i in range(n):
        body = words(rng, rng.randrange(20, 120))
        bad, toxic = i % 6 == 0, i % 5 == 0
        if toxic:
            w = body.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["moron", "scum", f"zorb{rng.randrange(90)}x"]))
            body = " ".join(w)
        texts.append(body.upper().replace(" ", "!! ") if bad else body + ".")
        y.append(0 if bad else 1)
        t.append(int(toxic))
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, y[i], t[i]) for i in range(n)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    return table, labels, y, t


def test_quality_rules_hold_out(spark):
    table, labels, y, _ = labelled(spark)
    odd = docs(spark, [None, "", "x " * 200_000], ids=[None, 901, 902])
    model = fit_quality(table, labels)
    rows = score_quality(table.unionByName(odd).withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == 903 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert sum(r.predicted == y[r.doc_id] for r in held) / len(held) > 0.98
    names = list(statistics(F.lit("")))
    x = np.array([[float(v) for v in r] for r in table.select(*[c.alias(n) for n, c in statistics(F.col("text")).items()]).collect()])
    by_id = {r.doc_id: r.score for r in rows}
    assert len(names) == x.shape[1] and np.allclose(model.predict(x), [by_id[i] for i in range(900)])
    assert score_quality(odd, fit_quality(table, labels.limit(0))).first().score == pytest.approx(0.5)
    assert fit_rules(["a"], np.zeros((3, 1)), np.ones(3)).predict(np.zeros((1, 1)))[0] > 0.99


def test_toxicity_holds_out_and_reads_characters(spark):
    table, labels, _, t = labelled(spark)
    net = fit_toxicity(table, labels)
    odd = docs(spark, [None, "", "é " * 3000, "zorbnew1x " + "w1 " * 30, "w1 " * 2000 + "moron " + "w2 " * 2000], ids=[None, 901, 902, 903, 904])
    rows = score_toxicity(table.unionByName(odd), net).collect()
    assert len(rows) == 905 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert sum(r.predicted == t[r.doc_id] for r in held) / len(held) > 0.95
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[904] > 0.7 > by_id[901]
    assert score_toxicity(odd, fit_toxicity(table, labels.limit(0))).first().score == 0.5


def test_toxicity_reads_words_to_their_end():
    from usagelake.llm.toxicity import words_of

    net = Network([b"a"], seed=1)
    same = lambda a, b: np.allclose(net.inputs(words_of(a)), net.inputs(words_of(b)))
    assert same("goodmorningmoron", "GoodMorningMoron") and not same("goodmorningmoron", "goodmorningfolks")
    for letter in ("a", "\u4e00", "\u0436"):
        for n in (12, 33, 200):
            assert not same(letter * n + "x", letter * n + "y")
    assert len(words_of("ab " + "c" * 100)) == 1 + 6 and max(map(len, words_of("c" * 1001))) == 32
    with np.errstate(all="raise"):
        assert net.inputs([b"", b"a", b"ab"]).shape == (3, 48)


def test_gradients_agree_with_differences():
    net = Network([b"a", b"b"], seed=3)
    rng = np.random.default_rng(0)
    x, mask = rng.normal(size=(5, 20, 4)), np.array([[1, 1, 1, 1], [1, 1, 1, 1], [1, 1, 1, 0], [1, 1, 0, 0], [1, 0, 0, 0]], float)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y, weight = np.array([0, 1, 1, 0.0]), np.array([1, 2, 1, 1.0])

    def loss():
        p = net.p
        z = net.forward(np.matmul(p["wf"], x) + p["cf"][:, None], np.matmul(p["wb"], x) + p["cb"][:, None], mask)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())

    g, d_x = net.gradients(x, mask, y, weight)
    for name in ("wf", "uf", "cf", "wb", "ub", "a", "ab", "v", "o", "ob"):
        at = tuple(rng.integers(0, n) for n in net.p[name].shape)
        net.p[name][at] += 1e-5
        up = loss()
        net.p[name][at] -= 2e-5
        down = loss()
        net.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][at]) < 2e-3, name
    x[1, 3, 2] += 1e-5
    up = loss()
    x[1, 3, 2] -= 2e-5
    assert abs((up - loss()) / 2e-5 - d_x[1, 3, 2]) < 2e-3


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 48, 49, 64, 1000])
def test_windows_cover_all_words(n):
    at = windows(n)
    assert at[0] == 0 and all(b - a == 16 for a, b in itertools.pairwise(at)) and at[-1] + 32 >= n and (len(at) == 1 or at[-2] + 32 < n)


def test_fast_scores_equal_forward():
    rng = np.random.default_rng(4)
    net = Network([b"a", b"b", b"c"], seed=5)
    vocabulary = [b"a", b"b", b"c", b"other", b"x" * 20]
    table = net.inputs(vocabulary)
    which = rng.integers(0, 5, (32, 40))
    mask = (np.arange(32)[:, None] < rng.integers(1, 33, 40)[None]).astype(np.float32)
    x = table[which].transpose(0, 2, 1).copy()
    want = net.forward(x[:, :24], x[:, 24:], mask)
    products = np.ascontiguousarray(table.T)
    products[:16] *= 0.5
    products[24:40] *= 0.5
    assert np.allclose(net.scores(products.astype(np.float32), which, mask), want, atol=1e-4)


def test_batches_don_t_matter():
    rng = random.Random(13)
    texts = [words(rng, rng.randrange(0, 300)) for _ in range(60)] + ["", None]
    net = train(texts[:40], np.array([i % 2 for i in range(40)], float), rounds=2)
    alone = [list(Scorer(net).logits([t]))[0] for t in texts]
    assert np.allclose(list(Scorer(net).logits(texts)), alone, atol=1e-4) and sigmoid(np.array([0.0]))[0] == 0.5
