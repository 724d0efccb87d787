"""Byte-level BPE encoding and decoding with a given vocabulary file, one segment tree for each piece of text.

1. A text is cut at the vocabulary's added tokens (leftmost, longest first), and what is between into pieces: contractions, runs of letters,
   digits or other signs with at most one space before them, and white space.
2. A piece is the ids of its bytes. A segment tree over its adjacent pairs holds at each leaf the pair's merge rank and place;
   the root thus gives the leftmost pair of lowest rank. A merge changes three leaves and their paths to the root,
   so a piece of n bytes takes O(n log n), and it ends when no pair at the root can be merged.
3. Decoding joins the bytes of the ids.

The trees of many short pieces are arrays side by side, and a step of numpy takes each of them one merge on (`merged_all`); longer pieces have a
tree by themselves (`merged`). Ids are packed, 4 bytes each, little-endian. Pieces met again are looked up in a table of bounded size. Texts are worked
on some CHUNK characters at a time; longer ones are cut where white space follows something else, which is always the end of a piece, so
the ids don't change.

Defined cases: a null text is empty; bytes that aren't UTF-8 are read as replacement characters; texts may contain added tokens, which are
encoded as such; ids that the vocabulary lacks can't be decoded and raise ValueError; both functions make columns, so other columns are untouched.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What the byte-level scheme takes as one piece: fixed by the vocabularies made with it.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that are cut into pieces at once.
CHUNK = 1 << 19
#: Pieces that are remembered.
REMEMBERED = 100_000
#: Bytes of the pieces whose trees stand side by side, by the width of a tree; so many trees at once.
WIDTHS, ABREAST = (8, 16, 32, 64), 1 << 13
NEVER = 1 << 62
#: A vocabulary file goes to all workers, so it must be no larger.
MOST_BYTES = 64 << 20


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, others for the next free code points from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def merged(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """symbols after all merges; merges maps a pair to its rank and the id it becomes."""
    n = len(symbols)
    if n < 2:
        return symbols
    width = 1 << (n - 2).bit_length()
    tree = [NEVER] * (2 * width)

    def key(left: int, right: int, place: int) -> int:
        found = merges.get((left, right))
        return NEVER if found is None else found[0] << 32 | place

    for i in range(n - 1):
        tree[width + i] = key(symbols[i], symbols[i + 1], i)
    for p in range(width - 1, 0, -1):
        tree[p] = min(tree[2 * p], tree[2 * p + 1])

    def put(place: int, value: int) -> None:
        p = width + place
        tree[p] = value
        while p > 1:
            p >>= 1
            least = min(tree[2 * p], tree[2 * p + 1])
            if tree[p] == least:
                return
            tree[p] = least

    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] != NEVER:
        left = tree[1] & 0xFFFFFFFF
        right = after[left]
        symbols[left] = merges[symbols[left], symbols[right]][1]
        following = after[left] = after[right]
        symbols[right] = -1
        if right < n - 1:
            put(right, NEVER)
        if following < n:
            before[following] = left
        put(left, key(symbols[left], symbols[following], left) if following < n else NEVER)
        if before[left] >= 0:
            put(before[left], key(symbols[before[left]], symbols[left], before[left]))
    return [s for s in symbols if s >= 0]


def merged_all(symbols: np.ndarray, sizes: np.ndarray, codes: np.ndarray, ranks: np.ndarray, becomes: np.ndarray) -> np.ndarray:
    """`merged` for each row of symbols, of which the first sizes[row] count: what is merged away becomes -1.

    codes are the mergeable pairs, left << 32 | right, in order; ranks are theirs, and becomes[rank] is the new id.
    """
    rows, width = symbols.shape
    flat, place = symbols.reshape(-1), np.arange(width)
    after = np.broadcast_to(place + 1, symbols.shape).reshape(-1).copy()
    before = after - 2

    def key(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        found = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        return np.where(codes[found] == wanted, ranks[found] << 32 | at, NEVER)

    tree = np.full((rows, 2 * width), NEVER)
    row, at = np.nonzero(place < sizes[:, None] - 1)
    tree[row, width + at] = key(symbols[row, at], symbols[row, at + 1], at)
    for level in (width >> k for k in range(1, width.bit_length())):
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    tree = tree.reshape(-1)

    def put(row: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
        root, node = row * (2 * width), width + at
        tree[root + node] = value
        while node.size and node[0] > 1:
            node = node >> 1
            tree[root + node] = np.minimum(tree[root + 2 * node], tree[root + 2 * node + 1])

    going = np.flatnonzero(tree[1 :: 2 * width] != NEVER)
    while going.size:
        best = tree[going * (2 * width) + 1]
        left, base = best & 0xFFFFFFFF, going * width
        right = after[base + left]
        following = after[base + right]
        flat[base + left] = becomes[best >> 32]
        flat[base + right] = -1
        after[base + left] = following
        more = following < sizes[going]
        before[base[more] + following[more]] = left[more]
        put(going, right, NEVER)
        value = np.full(going.size, NEVER)
        value[more] = key(flat[base[more] + left[more]], flat[base[more] + following[more]], left[more])
        put(going, left, value)
        first = before[base + left]
        some = first >= 0
        put(going[some], first[some], key(flat[base[some] + first[some]], flat[base[some] + left[some]], first[some]))
        going = going[tree[going * (2 * width) + 1] != NEVER]
    return symbols


class Codec(dict):
    """Encodes and decodes by a vocabulary in the JSON format of byte-level BPE; as a dict it maps a piece to its packed ids."""

    def __init__(self, definition: str) -> None:
        import regex

        made = json.loads(definition)
        model, cut = made["model"], made["pre_tokenizer"] or {}
        others = [made.get("normalizer"), cut.get("add_prefix_space"), *(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges"))]
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or any(others):
            raise ValueError("not a vocabulary of plain byte-level BPE")
        letters, vocab = byte_letters(), model["vocab"]
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        order = sorted((a << 32 | b, rank) for (a, b), (rank, _) in self.merges.items())
        self.codes, self.ranks = (np.array([x[k] for x in order] or [-1]) for k in (0, 1))
        self.becomes = np.zeros(len(pairs) + 1, np.int64)
        for rank, made_id in self.merges.values():
            self.becomes[rank] = made_id
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in made.get("added_tokens") or []}
        if any(t[k] for t in made.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take their surroundings in aren't supported")
        self.bytes_of |= {i: content.encode() for content, i in self.added.items()}
        self.pieces = regex.compile(PIECE)
        self.edge = regex.compile(r"\S(?=\s)")
        self.marks = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def learn(self, pieces: list[str]) -> None:
        """Adds pieces, all of them different, to what is remembered."""
        known = [p.encode() for p in pieces]
        lengths = np.array([len(k) for k in known], np.int64)
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            chosen = np.flatnonzero((lengths > low) & (lengths <= width))
            for start in range(0, chosen.size, ABREAST):
                part = chosen[start : start + ABREAST]
                symbols = np.full((part.size, width), -1)
                symbols[np.arange(width) < lengths[part][:, None]] = self.of_byte[np.frombuffer(b"".join([known[i] for i in part]), np.uint8)]
                symbols = merged_all(symbols, lengths[part], self.codes, self.ranks, self.becomes)
                packed, ends = symbols[symbols >= 0].astype("<u4").tobytes(), np.cumsum((symbols >= 0).sum(1) * 4).tolist()
                self.update(zip([pieces[i] for i in part], (packed[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        for i in np.flatnonzero(lengths > WIDTHS[-1]):
            self[pieces[i]] = np.array(merged(self.of_byte[np.frombuffer(known[i], np.uint8)].tolist(), self.merges), "<u4").tobytes()

    def chunks(self, text: str) -> Iterator[str | bytes]:
        """Packed ids of added tokens, and what is between them, in chunks whose ends are ends of pieces."""
        for i, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if i % 2:
                yield self.added[part].to_bytes(4, "little")
                continue
            start = 0
            while start < len(part):
                edge = self.edge.search(part, start + CHUNK) if len(part) - start > CHUNK else None
                stop = edge.end() if edge else len(part)
                yield part[start:stop]
                start = stop

    def encoded(self, texts: Iterable[str]) -> list[bytes]:
        done: list[list[bytes]] = []
        waiting: list[tuple[int, list[str] | bytes]] = []

        def work() -> None:
            pieces = set().union(*(cut for _, cut in waiting if isinstance(cut, list)))
            new = pieces.difference(self)
            if len(self) + len(new) > REMEMBERED:
                self.clear()
                new = pieces
            self.learn(list(new))
            for text, cut in waiting:
                done[text].append(b"".join(map(self.__getitem__, cut)) if isinstance(cut, list) else cut)
            waiting.clear()

        held = 0
        for number, text in enumerate(texts):
            done.append([])
            for chunk in self.chunks(text):
                waiting.append((number, chunk if isinstance(chunk, bytes) else self.pieces.findall(chunk)))
                held += len(chunk)
                if held >= CHUNK:
                    work()
                    held = 0
        work()
        return [b"".join(parts) for parts in done]

    def encode(self, text: str) -> bytes:
        return self.encoded([text])[0]

    def decode(self, packed: bytes) -> str:
        try:
            return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode(errors="replace")
        except KeyError as unknown:
            raise ValueError(f"no token has the id {unknown}") from None


_codecs: dict[str, Codec] = {}


class Vocabulary:
    """A vocabulary file as column functions. The file is read on the driver; workers get its text once each."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        if os.path.getsize(path) > MOST_BYTES:
            raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
        with open(path, encoding="utf-8") as file:
            definition = file.read()
        Codec(definition)  # what can't be read fails here, not in a task
        shared = spark.sparkContext.broadcast(definition)

        def codec() -> Codec:
            if path not in _codecs:
                _codecs[path] = Codec(shared.value)
            return _codecs[path]

        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            one = codec()
            for texts in batches:
                yield pa.array(one.encoded(t.decode(errors="replace") for t in texts.cast(pa.binary()).to_pylist()), pa.binary())

        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            one = codec()
            for ids in batches:
                yield pa.array([one.decode(i) for i in ids.to_pylist()], pa.string())

        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for ids in encode(batches):
                yield pa.StructArray.from_arrays([ids, *decode(iter([ids]))], ["ids", "text"])

        encode.__annotations__ = decode.__annotations__ = both.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        self._encode, self._decode = F.arrow_udf(encode, "binary"), F.arrow_udf(decode, "string")
        self._both = F.arrow_udf(both, "struct<ids: binary, text: string>")

    def encode(self, text: Column) -> Column:
        """The packed ids of a text."""
        return self._encode(F.coalesce(text, F.lit("")))

    def decode(self, packed: Column) -> Column:
        """The text of packed ids."""
        return self._decode(F.coalesce(packed, F.lit(b"")))

    def round_trip(self, text: Column) -> Column:
        """struct(ids, text): the packed ids of a text and what they decode to, both by the same worker."""
        return self._both(F.coalesce(text, F.lit("")))


def token_count(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")
