"""Fuzzy removal of repeated lines; built-in functions only.

A line is normalised (lower case, ASCII marks and blanks one space, each letter of a script without spaces a word). Equal normalised lines form one class,
known by 128 bits of hash. Lines whose edit similarity reaches the threshold are linked; components of links keep
their first occurrence, by (doc_id, line), all others go.

Candidates meet in blocks. A line's blocks are the BLOCKS_OF of its distinct word triples with the least hashes. An edit changes three triples
of a line at most, so lines of 6 to 13 words find all their partners at a similarity of 0.8, as do shorter ones, whose word
pairs are blocks too; of longer lines some triples are no block, and with edits at random places one partner in a hundred
at the threshold is missed, fewer above it.

Classes that share a block are compared if their lengths and 256-bit maps of words leave the similarity possible, by the edit distance over
words. PIVOTS classes of each block meet all of it, and then each class that this leaves outside of the block's largest group meets the
block's classes of other groups, so that the components are those of all pairs of a block. In blocks of more than SHARED classes only those
meet that have one of their rarest words in common; all pairs at the similarity do, so that changes the work and not what is found.

line_links finds candidates by SimHash within BITS bits instead, which misses most pairs of lines at the threshold; op4 doesn't use it.

Defined cases: null texts have no lines; blank lines are left alone, and so are those of fewer than min_words words
(op4 takes all; at 0.8 lines of fewer than four words repeat only if they are equal); rows that repeat
id and text count as one document and keep the same lines; null ids come last among occurrences; very long
lines are counted whole; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import gc
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.llm.common import dropped, prefiltered, scratch, written
from usagelake.llm.graph import connected_components

MIN_WORDS = 5
#: Letters, with the marks on them, of scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Han.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]\p{M}*"
BITS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  #: first bit and bits of each block
LANES = 0x0101010101010101
BUCKET = 64
LONG = 4
BLOCKS_OF = 8  #: blocks of a line, at most
BANDS = (4, 32, 256)  #: edits that are tried first, since the cost grows with the edits allowed
SHARED = 1024
PIVOTS = 4
FREQUENT = 4096
MAPS = tuple(f"m{k}" for k in range(4))
#: Characters from FIRST_SIGN on that stand for words.
FIRST_SIGN, SIGNS = 0x4E00, 20_000


def spaced(text: Column) -> Column:
    """Lower-cased; ASCII marks and blanks other than line feeds one space, and spaces around letters of scripts without spaces."""
    lower = F.lower(text)
    lower = F.when(lower.rlike(r"[\u0E00-\x{3FFFF}]"), F.regexp_replace(lower, UNSPACED, " $0 ")).otherwise(lower)
    return F.regexp_replace(lower, r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")


def normalised(line: Column) -> Column:
    return F.trim(spaced(line))


def simhash(words: Column) -> Column:
    """The 64-bit SimHash of an array of words."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 127).cast("int")), lambda k: F.transform(F.slice(words, k * 127 + 1, 127), lambda w: F.xxhash64(w)))

    def votes(part: Column) -> Column:
        lanes = F.struct(*[F.lit(0).cast("long").alias(f"v{k}") for k in range(8)])
        return F.aggregate(part, lanes, lambda v, h: F.struct(*[(v[f"v{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES))).alias(f"v{k}") for k in range(8)]))

    def unpacked(v: Column) -> Column:
        return F.array(*[F.shiftrightunsigned(v[f"v{bit % 8}"], bit // 8 * 8).bitwiseAND(F.lit(255).cast("long")) for bit in range(64)])

    # Each step's value is bound to a lambda's argument, or it would be computed anew wherever it is used.
    counted = F.transform(F.transform(parts, votes), unpacked)
    counts = F.aggregate(counted, F.array_repeat(F.lit(0).cast("long"), 64), lambda total, part: F.zip_with(total, part, lambda a, b: a + b))
    set_bits = F.transform(counts, lambda c, bit: F.when(c * 2 > F.size(words), F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(set_bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def code_of(words: Column) -> Column:
    def chosen(words: Column) -> Column:
        return F.transform(F.array(F.filter(words, lambda w: F.length(w) >= LONG)), lambda long: F.when(F.size(long) >= MIN_WORDS, long).otherwise(words))[0]

    # As in simhash, each value is bound once: words, the words chosen, their code.
    return F.transform(F.transform(F.array(words), chosen), simhash)[0]


def block(code: Column, k: int) -> Column:
    first, bits = BLOCKS[k]
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def alike(rows: DataFrame, a: str, b: str, similarity: float) -> DataFrame:
    """Rows whose lines a and b have the edit similarity: 1 - word edits / words of the longer line.

    Words that both lines start or end with are set aside first, which leaves the distance as it is. Each word that
    is left stands as one of SIGNS characters, by hash, for the edit distance of strings; so long lines cost
    little, and two different words count as equal once in SIGNS times.
    """
    rows = rows.withColumn("_x", F.split(a, " ")).withColumn("_y", F.split(b, " ")).withColumn("_n", F.least(F.size("_x"), F.size("_y")))
    rows = rows.withColumn("_most", F.floor(F.greatest(F.size("_x"), F.size("_y")) * (1 - similarity) + 1e-9).cast("int")).where(F.abs(F.size("_x") - F.size("_y")) <= F.col("_most"))

    def agreeing(x: Column, y: Column, n: Column) -> Column:
        differs = F.array_position(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p == q), False)
        return F.when(differs == 0, n).otherwise((differs - 1).cast("int"))

    rows = rows.withColumn("_head", agreeing(F.col("_x"), F.col("_y"), F.col("_n")))
    rows = rows.withColumn("_tail", agreeing(F.reverse("_x"), F.reverse("_y"), F.col("_n") - F.col("_head")))
    sign = lambda w: F.decode(F.unhex(F.hex(F.pmod(F.xxhash64(w), F.lit(SIGNS)) + FIRST_SIGN)), "UTF-16BE")
    middle = lambda x: F.array_join(F.transform(F.slice(x, F.col("_head") + 1, F.size(x) - F.col("_head") - F.col("_tail")), sign), "")
    rows = rows.withColumn("_d", F.call_function("levenshtein", middle("_x"), middle("_y"), F.col("_most")))
    return rows.where("_d between 0 and _most").drop("_most", "_x", "_y", "_n", "_head", "_tail", "_d")


def across(large: DataFrame, links: DataFrame, texts: DataFrame, similarity: float, near: Column) -> DataFrame:
    """Links between classes of large buckets that are near and that links leave in different components."""
    found = connected_components(links, "a", "b").select(F.col("node").alias("class"), "component")
    placed = written(large.join(found, "class", "left").withColumn("component", F.coalesce("component", "class")), "line-placed")
    apart = (F.col("x.class") < F.col("y.class")) & (F.col("x.component") != F.col("y.component"))
    return written(verified(met(placed, placed, ["bucket"], apart & near), texts, similarity), "line-links")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes whose lines are alike."""
    pairs = written(pairs.distinct(), "line-pairs")
    left, right = (prefiltered(texts, F.col("class"), pairs, F.col(c)).select(F.col("class").alias(c), F.col("line").alias(f"line_{c}")) for c in ("a", "b"))
    return alike(pairs.join(left, "a").join(right, "b"), "line_a", "line_b", similarity).select("a", "b")


def other_bits(code: Column, i: int, j: int) -> Column:
    """The bits of the blocks other than i and j in one number."""
    out, at = F.lit(0).cast("long"), 0
    for k, (_, bits) in enumerate(BLOCKS):
        if k not in (i, j):
            out, at = out.bitwiseOR(F.shiftleft(block(code, k), at)), at + bits
    return out


def sized(rows: DataFrame) -> DataFrame:
    """rows in shared buckets, with the bucket's size."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return written(rows.join(sizes, "bucket"), "line-buckets")


def bucket_pairs(rows: DataFrame) -> DataFrame:
    """a, b: classes of a bucket within BITS bits; rows are of buckets of at most BUCKET classes."""
    full = rows.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("class", "code"))).alias("all"))
    one = full.select(F.posexplode("all").alias("place", "x"), "all")
    near_ones = F.filter(F.slice("all", F.col("place") + 2, F.lit(BUCKET)), lambda y: F.bit_count(y["code"].bitwiseXOR(F.col("x.code"))) <= BITS)
    return one.select(F.col("x.class").alias("a"), F.explode(F.transform(near_ones, lambda y: y["class"])).alias("b"))


def line_links(docs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """a, b: links between classes (class, code, and one, where its line stands in docs)."""
    code = F.col("code")
    keys = [F.struct(F.xxhash64(F.lit(i * 8 + j), block(code, i), block(code, j)).alias("bucket"), other_bits(code, i, j).alias("rest")) for i, j in combinations(range(len(BLOCKS)), 2)]
    rows = sized(classes.select("class", "code", F.explode(F.array(*keys)).alias("key")).select("class", "code", "key.bucket", "key.rest"))
    quarters = [F.xxhash64("bucket", F.lit(q), F.shiftrightunsigned("rest", q * 10).bitwiseAND(F.lit(1023).cast("long"))) for q in range(4)]
    split = sized(rows.where(F.col("size") > BUCKET).select("class", "code", F.explode(F.array(*quarters)).alias("bucket")))
    # Most lines share no bucket with another and are never read back.
    texts = written(lines_of(docs, classes.join(rows.select("class").distinct(), "class", "left_semi")), "line-texts")
    small = rows.where(F.col("size") <= BUCKET).select("bucket", "class", "code").unionByName(split.where(F.col("size") <= BUCKET).select("bucket", "class", "code"))
    links = written(verified(bucket_pairs(small), texts, similarity), "line-links")
    large = split.where(F.col("size") > BUCKET).select("bucket", "class", "code")
    open_ = large
    while not open_.isEmpty():
        # Each bucket's least open class meets all classes of the bucket.
        pivot = open_.groupBy("bucket").agg(F.min(F.struct("class", "code")).alias("p"))
        met = large.join(pivot, "bucket").where(F.bit_count(F.col("code").bitwiseXOR(F.col("p.code"))) <= BITS).select("bucket", F.col("p.class").alias("a"), F.col("class").alias("b"))
        found = written(verified(met.where("a <> b").select("a", "b"), texts, similarity), "line-links")
        closed = met.join(found, ["a", "b"], "left_semi").select("bucket", F.col("b").alias("class")).unionByName(pivot.select("bucket", F.col("p.class").alias("class")))
        open_ = written(open_.join(closed, ["bucket", "class"], "left_anti"), "line-open")
        links = links.unionByName(found)
    near = F.bit_count(F.col("x.code").bitwiseXOR(F.col("y.code"))) <= BITS
    return links if large.isEmpty() else links.unionByName(across(large, links, texts, similarity, near))


def edits(n: Column, similarity: float) -> Column:
    """Word edits that lines may differ by, if the longer one has n words."""
    return F.floor(n * (1 - similarity) + 1e-9).cast("int")


def line_keys(lines: DataFrame) -> DataFrame:
    """row, h1, h2, n, and k0 to k7: the blocks of each line (row, h1, h2, line) as numbers, least first.

    Each step is a column of its own, so that sorting is done on plain longs, outside of lambdas.
    """
    x, n = F.col("x"), F.size("x")
    pair = lambda w, i: F.xxhash64(w, F.get(x, i + 1))
    pairs = F.slice(F.transform(x, pair), F.lit(1), F.greatest(n - 1, F.lit(0)))
    triples = F.slice(F.transform(x, lambda w, i: F.xxhash64(pair(w, i), F.get(x, i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0)))
    blocks = F.when(n > 5, triples).when(n > 1, F.concat(triples, pairs)).otherwise(F.array().cast("array<bigint>"))
    words = lines.select("row", "h1", "h2", F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("x"))
    least = words.select("row", "h1", "h2", n.alias("n"), F.sort_array(F.array_distinct(blocks)).alias("y"))
    return least.select("row", "h1", "h2", "n", *[F.get("y", F.lit(k)).alias(f"k{k}") for k in range(BLOCKS_OF)])


def mapped(lines: DataFrame) -> DataFrame:
    """class, n and maps of the words, of lines (class, line)."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    part = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(len(MAPS) - 1).cast("long"))
    words = lines.select("class", F.explode(F.split("line", " ")).alias("w")).select("class", F.xxhash64("w").alias("h"))
    return words.groupBy("class").agg(F.count("*").cast("int").alias("n"), *[F.coalesce(F.bit_or(F.when(part == k, one)), F.lit(0).cast("long")).alias(m) for k, m in enumerate(MAPS)])


def signed(lines: DataFrame) -> DataFrame:
    """class, n and sign (each word as one of SIGNS characters, by hash) of lines (class, line)."""
    alphabet = F.split(F.lit(",".join(chr(FIRST_SIGN + k) for k in range(SIGNS))), ",")
    sign = lambda w: F.get(alphabet, F.pmod(F.xxhash64(w), F.lit(SIGNS)).cast("int"))
    return lines.select("class", F.split("line", " ").alias("words")).select("class", F.size("words").alias("n"), F.array_join(F.transform("words", sign), "").alias("sign"))


def possible(a: str, b: str, similarity: float) -> Column:
    """Whether lengths and maps of the classes a and b leave the similarity possible."""
    lacks = lambda x, y: sum((F.bit_count(F.col(f"{x}.{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{k}")))) for k in MAPS), F.lit(0))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = edits(F.greatest(n, m), similarity)
    return (F.abs(n - m) <= most) & (lacks(a, b) <= most - F.greatest(m - n, F.lit(0))) & (lacks(b, a) <= most - F.greatest(n - m, F.lit(0)))


def similar(a: str, b: str, similarity: float) -> Column:
    """Whether the classes a and b have the edit similarity; two different words count as equal once in SIGNS times."""
    most = edits(F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n")), similarity)
    within = lambda d: F.call_function("levenshtein", F.col(f"{a}.sign"), F.col(f"{b}.sign"), d) >= 0
    out = within(most)
    for band in reversed(BANDS):
        out = F.when(within(F.least(most, F.lit(band))), True).when(most <= band, False).otherwise(out)
    return out


def met(rows: DataFrame, others: DataFrame, on: list[str], which: Column) -> DataFrame:
    """a, b: the classes of rows x and others y that agree in the columns on and for which the condition holds."""
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on]
    pairs = rows.alias("x").join(others.alias("y"), [*same, which])
    return pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))


def shared_blocks(classes: DataFrame) -> DataFrame:
    """class, bucket, size: the blocks of classes (class, keys) that several classes have, with their number."""
    keyed = classes.where(F.col("keys").isNotNull()).select("class", F.explode("keys.first").alias("bucket"))
    # Most blocks have one class, whose rows go no further than their count.
    sizes = written(keyed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "line-sizes")
    return written(prefiltered(keyed, F.col("bucket"), sizes, F.col("bucket")).join(sizes, "bucket"), "line-buckets")


def edit_links(docs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """a, b: links between classes (class, keys, and one, where its line stands in docs) as block_links finds them."""
    rows = shared_blocks(classes)
    lines = written(lines_of(docs, classes.join(rows.select("class").distinct(), "class", "left_semi")), "line-texts")
    return block_links(rows, lines, similarity)


def block_links(rows: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """a, b: links between classes whose components are those of all similar pairs that share a block.

    rows: blocks (class, bucket, size); lines: class, line of each class that has one.
    """
    maps = written(mapped(lines), "line-maps")
    freed(lines)
    near = possible("x", "y", similarity)
    # Each class of a block meets the block's pivots, so candidates are as many as the rows of blocks.
    least = F.array(*[F.min_by("class", F.xxhash64("class", F.lit(k))) for k in range(PIVOTS)])
    pivots = written(rows.groupBy("bucket").agg(F.first("size").alias("size"), F.array_distinct(least).alias("p")), "line-pivots")
    first = met(pivots.select("bucket", F.explode("p").alias("class")).join(maps, "class"), rows.join(maps, "class"), ["bucket"], (F.col("x.class") != F.col("y.class")) & near)
    links = linked_pairs(written(ordered(first), "line-candidates"), lines, similarity)
    found = hung_together(links).select(F.col("node").alias("class"), "component")
    freed(lines)
    # Where all classes but one are pivots, all pairs have met.
    unmet = pivots.where(F.size("p") < F.col("size") - 1).select("bucket")
    placed = rows.join(unmet, "bucket", "left_semi").join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    placed = written(placed, "line-placed")
    main = placed.groupBy("bucket", "component").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("main"))
    placed = written(placed.join(main, "bucket"), "line-open")
    rest = placed.where("component <> main")
    placed = placed.join(rest.select("bucket").distinct(), "bucket", "left_semi")
    # Classes outside of a block's largest group meet all of the block that other groups have.
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("x.class") < F.col("y.class")) | (F.col("y.component") == F.col("y.main"))) & near
    small, large = F.col("size") <= SHARED, F.col("size") > SHARED
    pairs = met(rest.where(small).join(maps, "class"), placed.where(small).join(maps, "class"), ["bucket"], apart)
    many = written(placed.where(large), "line-many")
    if not many.isEmpty():
        # Few lines are in large blocks; the texts of the others aren't shuffled.
        inside = prefiltered(lines, F.col("class"), many, F.col("class")).join(many.select("class").distinct(), "class", "left_semi")
        # Dealt by class as texts, lines needn't be dealt as words to count them.
        tokens = written(rarest_words(inside.repartition("class"), similarity).join(maps, "class"), "line-words")
        pairs = pairs.unionByName(met(rest.where(large).join(tokens, "class"), many.join(tokens, "class"), ["bucket", "token"], apart))
    return links.unionByName(linked_pairs(written(ordered(pairs), "line-candidates"), lines, similarity))


def freed(rows: DataFrame) -> None:
    """Lets Spark free the shuffle files of plans that are done with."""
    gc.collect()
    rows.sparkSession._jvm.System.gc()


def ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, a being the less."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def rarest_words(lines: DataFrame, similarity: float) -> DataFrame:
    """class, token: as many of the rarest words of each line (class, line), and one more, as edits may take from it.

    Lines at the similarity share one of those, whatever the order of words: of two lines the longer one, of m words, has all but edits(m) of
    them in the other, so both have one of them among so many of its first and one more. A word's second occurrence is a word of its own.
    """
    words = lines.select("class", F.explode(F.split("line", " ")).alias("w")).groupBy("class", F.xxhash64("w").alias("h")).agg(F.count("*").alias("times"))
    tokens = written(words.select("class", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time"), "h").select("class", F.xxhash64("h", "time").alias("token")), "line-tokens")
    # Words that are in fewer than one line of FREQUENT are all alike rare, which bounds what is broadcast.
    least = max(1, lines.count() // FREQUENT)
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where(F.col("often") > least)
    ranked = tokens.join(F.broadcast(often), "token", "left").groupBy("class").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token"))).alias("all"))
    return ranked.select("class", F.explode(F.slice("all", F.lit(1), edits(F.size("all"), similarity) + 1)).alias("t")).select("class", "t.token")


def linked_pairs(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose lines are similar."""
    paired = pairs.select(F.explode(F.array("a", "b")).alias("class"))
    signs = written(signed(prefiltered(lines, F.col("class"), paired, F.col("class"))), "line-signs")
    x, y = (signs.select(F.col("class").alias(c), F.struct("n", "sign").alias(name)) for c, name in (("a", "x"), ("b", "y")))
    return written(pairs.join(x, "a").join(y, "b").where(similar("x", "y", similarity)).select("a", "b"), "line-links")


def hung_together(links: DataFrame, hops: int = 3) -> DataFrame:
    """node, component: a label that classes within a few links of one another share mostly. Classes with the same label are
    connected; connected ones may have different labels."""
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "line-both")
    found = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    for _ in range(hops - 1):
        near = both.join(found.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("least"))
        found = found.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "least").alias("component"))
    return found


def lines_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """class, line: the normalised line of each class, read back from the document of its first occurrence."""
    wanted = classes.groupBy(F.col("one.key").alias("_key"), F.col("one.doc_id").alias("_id")).agg(F.collect_list(F.struct("class", F.col("one.number").alias("number"))).alias("wanted"))
    texts = prefiltered(docs.withColumn("key", F.xxhash64("text")), F.col("key"), wanted, F.col("_key"))
    found = texts.join(wanted, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    found = found.dropDuplicates(["key", "doc_id"]).withColumn("lines", F.split("text", "\n"))
    return found.select("lines", F.explode("wanted").alias("w")).select("w.class", normalised(F.element_at("lines", F.col("w.number") + 1)).alias("line"))


def repeated_lines(docs: DataFrame, similarity: float = 0.8, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key (of the text), gone: the numbers, from 0, of the lines of a document that repeat earlier ones."""
    docs = docs.select("doc_id", "text")
    # Texts are hashed before their lines are rows, and normalised within the generator: as a column of its own, Spark would
    # normalise them once more for a filter on that column.
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    lines = texts.select("doc_id", "key", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("number", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    if min_words > 1:
        lines = lines.where(F.size(F.split("line", " ")) >= min_words)
    lines = written(lines.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", "number", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line"), "lines", "zstd")
    names = ["n", *(f"k{k}" for k in range(BLOCKS_OF))]
    sets = line_keys(lines).groupBy("h1", "h2").agg(F.count("*").alias("times"), F.min("row").alias("row"), *[F.min(c).alias(c) for c in names])
    first = F.filter(F.array(*names[1:]), lambda k: k.isNotNull())
    keys = F.when(edits(F.col("n") + 1, similarity) > 0, F.struct("n", first.alias("first")))
    classes = written(sets.select("h1", "h2", "times", "row", F.monotonically_increasing_id().alias("class"), keys.alias("keys")), "line-classes")
    freed(lines)
    with scratch() as inner:
        rows = shared_blocks(classes)
        shared = rows.select("class").distinct().withColumn("shared", F.lit(True))
        named = classes.select("h1", "h2", "times", "row", "class").join(shared, "class", "left").where("times > 1 or shared")
        named = inner.keep(written(named, "line-named"))
        # Of the lines and keys, which are the largest tables, no more is held than what later steps read.
        dropped(classes)
        freed(rows)
        wanted = named.where("shared").select("row", "class")
        texts = prefiltered(lines.select("row", "line"), F.col("row"), wanted, F.col("row")).join(wanted, "row").select("class", "line")
        texts = written(texts, "line-texts", "zstd")
        places = inner.keep(written(lines.drop("row", "line"), "line-places"))
        dropped(lines)
        freed(rows)
        links = inner.keep(written(block_links(rows, texts, similarity), "line-all"))
    found = connected_components(links, "a", "b").select(F.col("node").alias("class"), "component")
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "number")
    again = written(named.join(found, "class", "left").where("times > 1 or component is not null").select("h1", "h2", "component"), "line-again")
    lines = written(prefiltered(places, F.col("h1"), again, F.col("h1")).join(again, ["h1", "h2"]), "line-found")
    ones = written(lines.groupBy("h1", "h2").agg(F.min(where).alias("one"), F.first("component").alias("component")), "line-ones")
    # A line that is like no other line is a component of its own, and needs no number.
    alone = ones.where("component is null").select("h1", "h2", F.col("one").alias("first"))
    linked = ones.where("component is not null")
    kept = alone.unionByName(linked.join(linked.groupBy("component").agg(F.min("one").alias("first")), "component").select("h1", "h2", "first"))
    gone = lines.drop("component").join(kept, ["h1", "h2"]).where(where != F.col("first"))
    return gone.groupBy("doc_id", "key").agg(F.collect_set("number").alias("gone"))


def without_repeated_lines(docs: DataFrame, similarity: float = 0.8, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, text (the lines kept) for each row of docs."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    with scratch() as inner:
        gone = inner.keep(written(repeated_lines(docs, similarity, min_words), "line-gone"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "gone")
    rows = docs.withColumn("_key_own", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key_own") == F.col("_key")), "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n"))
    return rows.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("text"))
