"""Benchmark decontamination: BM25 search of test items by every training passage, with block-max WAND.

Test items are cut into segments of at most SEGMENT words; those are the documents of a small inverted index
with BM25 weights, each divided by the segment's score for itself, so that 1 is a full match. Postings lie in blocks that
know their greatest weight. Each training text is cut into passages of PASSAGE words, a new one every STEP
words, over the whole text; a passage is a query of its distinct words. The segments lie in at most BLOCKS ranges
too; ranges in which the greatest weights of a passage's words don't add up to the threshold are dropped for all
passages of a text at once. In the others block-max WAND returns every segment at or above the threshold. A hit is verified on the text around the passage, which must hold
one of these: a run of SEGMENT words of the item at the segment (or the whole of a shorter item), or its whole question of at least n words, with word edits for at
most 1 - overlap of it; or enough of the question's word n-grams and of the answer's. An item without columns of its own for them is read so: what follows
its last question mark, else nothing, is the answer.

The index travels to the executors; benchmark items are therefore taken in blocks of at most BLOCK_CHARS
characters and each block searched by all passages. BM25 counts are those of the whole benchmark, so blocks don't matter.

Defined cases: null or blank texts and items match nothing; items shorter than an n-gram are one n-gram of their
whole; repeated items each get their hits; a null item_id keeps its hits; repeated rows hit alike; empty
tables give no hits; very long texts and items are read whole.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SEGMENT, PASSAGE, STEP = 48, 64, 32
BLOCK_CHARS = 8_000_000
POSTINGS = 64  #: of a block
BLOCKS = 64  #: ranges of segments
RUN_STEP = 6  #: words between the runs of an item that are tried
K1, B = 1.2, 0.75
HITS = "array<struct<item:bigint, score:double, question_overlap:double, answer_overlap:double, first_word:bigint>>"
SEPARATORS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(SEPARATORS).split()


def n_grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def parts_of(text: str | None, answer: str | None = None) -> tuple[list[bytes], list[bytes]]:
    if answer is None and text and "?" in text[:-1]:
        text, _, answer = text.rpartition("?")
    return words_of(text), words_of(answer)


@dataclass
class Counts:
    """What BM25 needs of all segments of the benchmark."""

    segments: int = 0
    words: int = 0
    df: Counter = field(default_factory=Counter)

    def add(self, items: list[tuple[list[bytes], list[bytes]]]) -> Counts:
        for _, _, low, high, bag in Index.segments(items):
            self.segments, self.words = self.segments + 1, self.words + high - low
            self.df.update(bag.keys())
        return self


@dataclass
class Index:
    items: list[tuple[list[bytes], list[bytes]]]  #: question and answer words
    of: list[int] = field(default_factory=list)  #: item of each segment
    spans: list[tuple[int, int]] = field(default_factory=list)  #: first word in its item of each segment, and the end
    lengths: list[int] = field(default_factory=list)  #: words of each item
    terms: dict[bytes, int] = field(default_factory=dict)
    postings: list[list[int]] = field(default_factory=list)  #: segments of each term, rising
    weights: list[list[float]] = field(default_factory=list)
    blocks: list[list[tuple[int, float]]] = field(default_factory=list)  #: last segment and greatest weight of each block
    most: list[float] = field(default_factory=list)  #: greatest weight of each term
    edges: list[int] = field(default_factory=list)  #: first segment of each range, and the end
    bounds: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))  #: greatest weight of each term in each range; last row: no term

    @staticmethod
    def segments(items: list[tuple[list[bytes], list[bytes]]]) -> Iterator[tuple[int, int, int, int, Counter]]:
        """Item, words of it, first word and end of a segment, and the segment's words, for each segment."""
        for item, (question, answer) in enumerate(items):
            words = question + answer
            count = -(-len(words) // SEGMENT)
            for part in range(count):
                low, high = len(words) * part // count, len(words) * (part + 1) // count
                yield item, len(words), low, high, Counter(words[low:high])

    @staticmethod
    def build(items: list[tuple[list[bytes], list[bytes]]], counts: Counts | None = None) -> Index:
        """counts: of the whole benchmark, where items are a block of it."""
        index = Index(items)
        index.lengths = [len(question) + len(answer) for question, answer in items]
        bags = []
        for item, _, low, high, bag in Index.segments(items):
            index.spans.append((low, high))
            index.of.append(item)
            bags.append(bag)
        counts = counts or Counts().add(items)
        n_segments, df, average = counts.segments, counts.df, counts.words / max(1, counts.segments)
        for segment, bag in enumerate(bags):
            size = sum(bag.values())
            weight = {w: math.log1p((n_segments - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * size / average)) for w, n in bag.items()}
            own = sum(weight.values())
            for w, x in weight.items():
                term = index.terms.setdefault(w, len(index.terms))
                if term == len(index.postings):
                    index.postings.append([])
                    index.weights.append([])
                index.postings[term].append(segment)
                index.weights[term].append(x / own)
        index.blocks = [[(p[min(i + POSTINGS, len(p)) - 1], max(w[i : i + POSTINGS])) for i in range(0, len(p), POSTINGS)] for p, w in zip(index.postings, index.weights, strict=True)]
        index.most = [max(w) for w in index.weights]
        n = min(BLOCKS, max(1, -(-len(bags) // 4)))
        index.edges = [len(bags) * k // n for k in range(n + 1)]
        index.bounds = np.zeros((len(index.terms) + 1, n), np.float32)
        ranges = np.searchsorted(index.edges, np.arange(len(bags)), "right") - 1
        for term, (segments, weights) in enumerate(zip(index.postings, index.weights, strict=True)):
            np.maximum.at(index.bounds[term], ranges[segments], weights)
        return index

    def search(self, terms: list[int], threshold: float, low: int, high: int) -> list[tuple[int, float]]:
        """All segments from low to before high whose score for the distinct terms reaches the threshold, by block-max WAND."""
        slack = threshold - 1e-9
        cursors, found = [], []  # segment, term, place
        for t in terms:
            at = bisect_left(self.postings[t], low)
            if at < len(self.postings[t]) and self.postings[t][at] < high:
                cursors.append([self.postings[t][at], t, at])
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for i, (_, t, _) in enumerate(cursors):
                total += self.most[t]
                if total >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            segment = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == segment:
                pivot += 1
            total, end = 0.0, None
            for _, t, _ in cursors[: pivot + 1]:
                at = bisect_left(self.blocks[t], (segment,))
                if at < len(self.blocks[t]):
                    total += self.blocks[t][at][1]
                    end = self.blocks[t][at][0] if end is None else min(end, self.blocks[t][at][0])
            if total >= slack:
                target = segment
                if cursors[0][0] == segment:
                    score = sum(self.weights[t][at] for s, t, at in cursors[: pivot + 1] if s == segment)
                    if score >= slack:
                        found.append((segment, score))
                    target = segment + 1
            else:
                target = (segment if end is None else end) + 1
                if pivot + 1 < len(cursors):
                    target = max(segment + 1, min(target, cursors[pivot + 1][0]))
            moved = []
            for c in cursors:
                if c[0] < target:
                    c[2] = bisect_left(self.postings[c[1]], target, c[2])
                    if c[2] == len(self.postings[c[1]]) or self.postings[c[1]][c[2]] >= high:
                        continue
                    c[0] = self.postings[c[1]][c[2]]
                moved.append(c)
            cursors = moved
        return found

    def hits(self, text: str | None, threshold: float, overlap: float, n: int) -> list[tuple[int, float, float, float, int]]:
        """item, score, overlaps, first word of the passage: the best verified passage for each item."""
        words = words_of(text)
        if not words or not self.terms:
            return []
        none = len(self.terms)
        ids = np.fromiter((self.terms.get(w, none) for w in words), np.int64, len(words))
        best: dict[int, tuple] = {}
        for first in range(0, max(1, len(words) - STEP), STEP * 256):
            # Sums over steps of words, then over the steps of each passage; a word that repeats counts again.
            part = self.bounds[ids[first : first + STEP * 256 + PASSAGE - STEP]]
            steps = np.add.reduceat(part, np.arange(0, len(part), STEP), 0)
            sums = sum(steps[k : len(steps) - PASSAGE // STEP + 1 + k] for k in range(PASSAGE // STEP)) if len(steps) >= PASSAGE // STEP else steps.sum(0, keepdims=True)
            for passage, block in np.argwhere(sums >= threshold - 1e-4).tolist():
                start = first + passage * STEP
                terms = np.unique(ids[start : start + PASSAGE])
                if self.bounds[terms, block].sum() < threshold - 1e-4:
                    continue
                for segment, score in self.search([int(t) for t in terms if t != none], threshold, self.edges[block], self.edges[block + 1]):
                    self.verify(best, words, start, segment, score, overlap, n)
        return [best[i] for i in sorted(best)]

    def verify(self, best: dict[int, tuple], words: list[bytes], start: int, segment: int, score: float, overlap: float, n: int) -> None:
        """Puts a hit into best, if the words around the passage hold enough of the item's question and answer."""
        item = self.of[segment]
        if item in best and score <= best[item][1]:
            return
        around = words[max(0, start - self.lengths[item]) : start + PASSAGE + self.lengths[item]]
        question, answer = (max(share(part, around, n), aligned(part, around)) for part in self.items[item])
        if min(question, answer) >= overlap or (question >= overlap and len(self.items[item][0]) >= n) or self.run_occurs(words, start, segment, overlap):
            best[item] = (item, score, question, answer, start)

    def run_occurs(self, words: list[bytes], start: int, segment: int, overlap: float) -> bool:
        """Whether a run of SEGMENT words of the item that overlaps the segment is aligned with the words around the passage."""
        item, (low, high) = self.of[segment], self.spans[segment]
        own = [w for part in self.items[item] for w in part]
        around = words[max(0, start - SEGMENT) : start + PASSAGE + SEGMENT]
        last = max(0, len(own) - SEGMENT)
        firsts = {min(last, max(0, at)) for at in range(low - SEGMENT // 2, high - SEGMENT // 2 + 1, RUN_STEP)} | {min(last, low)}
        return any(aligned(own[at : at + SEGMENT], around) >= overlap for at in sorted(firsts))


def aligned(part: list[bytes], around: list[bytes]) -> float:
    """1 - word edits / words of the part, for the run of words in around that needs least edits (bit-parallel); 1 for a part without words."""
    size = len(part)
    if not size:
        return 1.0
    places: dict[bytes, int] = {}
    for k, w in enumerate(part):
        places[w] = places.get(w, 0) | 1 << k
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, edits, least = full, 0, size, size
    for w in around:
        equal = places.get(w, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = (minus | ~(across | plus)) & full, plus & across
        edits += bool(up & top) - bool(down & top)
        least = min(least, edits)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = (down | ~(vertical | up)) & full, up & vertical
    return 1 - least / size


def share(part: list[bytes], around: list[bytes], n: int) -> float:
    """Share of the part's n-grams that occur around the passage; 1 for a part without words."""
    own = n_grams(part, n)
    return len(own & n_grams(around, min(n, len(part)))) / len(own) if own else 1.0


def indexes(benchmark: DataFrame) -> Iterator[tuple[list, Index]]:
    """Item ids and index of each block of the benchmark."""
    has_answer = "answer" in benchmark.columns
    items = benchmark.select("item_id", F.col("question" if "question" in benchmark.columns else "text").alias("text"), (F.col("answer") if has_answer else F.lit(None).cast("string")).alias("answer"))
    chars = items.agg(F.sum(F.length(F.coalesce("text", F.lit(""))) + F.length(F.coalesce("answer", F.lit("")))), F.count("*")).first()
    blocks = max(1, -(-(chars[0] or 0) // BLOCK_CHARS), -(-chars[1] // 100_000))

    def read(block: int) -> tuple[list, list]:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        return [r["item_id"] for r in rows], [parts_of(r["text"], r["answer"]) for r in rows]

    counts = Counts()
    for block in range(blocks):
        counts.add(read(block)[1])
    for block in range(blocks):
        names, parts = read(block)
        yield names, Index.build(parts, counts)


def hits_udf(names: list, index: Index, threshold: float, overlap: float, n: int):
    keys = ("item", "score", "question_overlap", "answer_overlap", "first_word")

    @F.pandas_udf(HITS)
    def hits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([[dict(zip(keys, (names[h[0]], *h[1:]), strict=True)) for h in index.hits(text, threshold, overlap, n)] for text in part], index=part.index, dtype=object)

    return hits


def with_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, n: int = 5) -> DataFrame:
    """The rows of docs as a struct `row`, with `hits`, an array of item, score, question_overlap, answer_overlap, first_word."""
    found = [hits_udf(names, index, threshold, overlap, n)(F.col("row.text")) for names, index in indexes(benchmark)]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("hits", F.concat(*found))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word of each verified hit."""
    found = with_hits(docs.select("doc_id", "text"), benchmark, **options)
    return found.select("row.doc_id", F.explode("hits").alias("h")).select("doc_id", F.col("h.item").alias("item_id"), "h.score", "h.question_overlap", "h.answer_overlap", "h.first_word")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without a verified hit."""
    return with_hits(docs, benchmark, **options).where(F.size("hits") == 0).select("row.*")
