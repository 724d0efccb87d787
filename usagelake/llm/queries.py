"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from usagelake.llm.common import table


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from usagelake.llm.suffix_dedup import remove_repeated

    return remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from usagelake.llm.line_dedup import without_repeated_lines

    rows = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1)
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from usagelake.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=3, num=85, den=100)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from usagelake.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from usagelake.llm.mixing import mixed_counts

    return mixed_counts(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from usagelake.llm.sharding import assign_shards

    rows = assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from usagelake.llm.toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from usagelake.llm.quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from usagelake.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from usagelake.llm.vector_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from usagelake.llm.resample import importance_ranks

    return importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from usagelake.llm.bpe import Vocabulary, token_count

    vocabulary = Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    rows = table(spark, sf_dir, "documents").select("doc_id", vocabulary.round_trip(F.col("text")).alias("made"))
    return rows.select("doc_id", token_count(F.col("made.ids")).alias("n_tokens"), F.sha2("made.ids", 256).alias("ids_sha256"), F.sha2(F.col("made.text").cast("binary"), 256).alias("decoded_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from usagelake.llm.merkle import folded, leaf, manifest, proof

    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = leaf([F.try_add(F.col(f), F.lit(1)) if f == "n_chars" else F.col(f) for f in fields])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = manifest(table(spark, sf_dir, "documents"), "doc_id", "lang", fields, keep={"altered": F.when(hit, altered)})
    rows = rows.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("sides"), F.col("siblings")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("siblings")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_mixing": op7_mixing,
    "op8_html": op8_html,
    "op9_sharding": op9_sharding,
    "op10_vector_topk": op10_vector_topk,
    "op11_resample": op11_resample,
    "op12_bpe": op12_bpe,
    "op13_merkle": op13_merkle,
}
#: Exact integers and ties, so SQL can say the same.
TOP_K = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
 where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
p as (select q.vec_id query_id, v.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]))::bigint score from v q join v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id and len(q.e) = len(v.e)),
r as (select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int "rank", vec_id, score from p)
select query_id, "rank", vec_id, score from r where "rank" <= 5"""

#: Sets of shingles by word arrays; linked sets share one of the rarest shingles of both; components by a recursive walk.
NEAR = """with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') a from documents),
s as (select doc_id, case when len(a) = 0 then [] when len(a) < 3 then [array_to_string(a, ' ')] else list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) end g from w),
c as (select min(doc_id) id, list_sort(g) g from s where len(g) > 0 group by list_sort(g)),
x as (select id, len(g) n, unnest(g) t from c),
f as (select *, count(*) over (partition by t) often from x),
head as (select * from f qualify row_number() over (partition by id order by often, t) <= n - ceil(n * 85 / 100.0) + 1),
cand as (select distinct l.id a, r.id b from head l join head r using (t) where l.id < r.id and 100 * least(l.n, r.n) >= 85 * greatest(l.n, r.n)),
links as (select a, b from (select a, b, len(list_intersect(p.g, q.g)) i, len(p.g) + len(q.g) m from cand join c p on p.id = a join c q on q.id = b) where 100 * i >= 85 * (m - i)),
both_ways as (select a, b from links union select b, a from links),
walk as (select id node, id reach from c union select node, b from walk join both_ways on reach = a),
comp as (select node, min(reach) component_id from walk group by node)
select doc_id, len(s.g)::bigint n_shingles, coalesce(component_id, doc_id) component_id, doc_id = coalesce(component_id, doc_id) kept from s left join c on list_sort(s.g) = c.g left join comp on comp.node = c.id"""

#: The same water level, points, ranks and blocks as llm.mixing makes, over whole sources at once.
MIXING = """with d as (select row_number() over () rid, doc_id, coalesce('s' || source, '~null') sk, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
  md5('mix:' || coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))) place from documents),
t0 as (select sk, sum(size)::bigint ss from d group by sk),
t1 as (select *, case (row_number() over (order by sk) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end w, ss * 2 cap, (sum(ss) over ())::bigint * 1.5::double wanted from t0),
t2 as (select *, coalesce(sum(cap) over (order by cap::double / w, sk rows between unbounded preceding and 1 preceding), 0)::bigint below, (sum(w) over (order by cap::double / w, sk rows between current row and unbounded following))::bigint onward from t1),
t3 as (select *, cap * onward <= w * (wanted - below) is_full from t2),
t4 as (select *, coalesce(sum(case when is_full then cap end) over (), 0)::bigint caps, (sum(case when not is_full then w end) over ())::bigint open_w from t3),
t5 as (select *, case when is_full then cap::double else w * (wanted - caps) / open_w end target from t4),
t6 as (select *, floor(sum(target) over (order by sk) / sum(target) over () * 2147483648)::bigint upto from t5),
t7 as (select *, coalesce(lag(upto) over (order by sk), 0) begins from t6),
points as (select n slot, ((n + 1) % 2147483648 * 1327217885) % 2147483648 p from range((select ((sum(round(target)::bigint) + 63) // 64)::bigint from t5)) r(n)),
slots as (select slot, sk, row_number() over (partition by sk order by slot) - 1 block from points join t7 on p >= begins and p < upto),
p as (select d.*, t5.ss, t5.target, coalesce(sum(size) over (partition by d.sk order by place rows between unbounded preceding and 1 preceding), 0)::bigint at_ from d join t5 using (sk)),
runs as (select rid, sk, at_ + turn * ss begins, at_ + turn * ss + size ends from p, range(2) t(turn) where size > 0),
pieces as (select rid, sum(least(ends, block * 64 + 64) - greatest(begins, block * 64))::bigint n from runs join slots using (sk) where block * 64 < ends and block * 64 + 64 > begins group by rid)
select doc_id, size, ss source_size, target, coalesce(n, 0) taken from p left join pieces using (rid)"""

#: CRC-32 by its table of 256 steps (t), over the bytes of a string f.
CRC_TABLE = """crc_table as (select list(c order by i) t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) r(i)))"""
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(hex(f)) // 2), lambda j: ('0x' || substr(hex(f), 2 * j + 1, 2))::bigint)), lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)))"""

RESAMPLE = rf"""with {CRC_TABLE},
d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
x as (select rid, unnest(w) f from d), y as (select unnest(w) f from b),
k as (select f, {CRC} % 10000 bucket from (select f from x union select f from y), crc_table),
s as (select bucket, count(*)::bigint s from x join k using (f) group by bucket), t as (select bucket, count(*)::bigint t from y join k using (f) group by bucket),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from x) + 10000)::double / ((s + 1)::double * ((select count(*) from y) + 10000)::double)))::bigint gain from s left join t using (bucket)),
m as (select rid, sum(gain)::bigint total, count(*)::bigint n from x join k using (f) join g using (bucket) group by rid),
w as (select rid, doc_id, coalesce(n, 0) n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::bigint weight,
  floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::varchar, 'null'))[1:8])::bigint + 0.5) / 4294967296)))::bigint noise from d left join m using (rid)),
e as (select rid, row_number() over (order by weight + noise desc, doc_id nulls last) place, (count(*) over () * 10) // 100 drawn from w where n_features >= 20)
select doc_id, n_features, weight, weight + noise score, case when place <= drawn then place end "rank" from w left join e using (rid)"""

MERKLE = f"""with recursive {CRC_TABLE},
fields as (select doc_id, coalesce('s' || lang, '') g, case when ({CRC}) % 7 = 0 then 1 else 0 end added,
  [doc_id::varchar, source, lang, n_chars::varchar, text] o, n_chars from (select *, doc_id::varchar f from documents), crc_table),
hashed as (select doc_id, g, list_aggregate(list_transform(o, lambda v: case when v is null then '-' else octet_length(encode(v)) || ':' || v end), 'string_agg', '') o,
  list_aggregate(list_transform([o[1], o[2], o[3], (n_chars + added)::varchar, o[5]], lambda v: case when v is null then '-' else octet_length(encode(v)) || ':' || v end), 'string_agg', '') c from fields),
leaves as (select doc_id, g, sha256(o) leaf, sha256(c) altered, row_number() over (partition by g order by doc_id, sha256(o)) - 1 pos, count(*) over (partition by g) n from hashed),
tree as (select g, 0 level, pos, n, leaf node from leaves
  union all select g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' order by pos)) from tree where n > 1 group by g, level, pos // 2, n),
ends as (select g, row_number() over (order by g) - 1 pos, count(*) over () n, node subroot from tree where n = 1),
crown as (select 0 level, pos, n, subroot node from ends
  union all select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' order by pos)) from crown where n > 1 group by level, pos // 2, n),
step as (select l.g, l.pos, h.level, case when s.node is null then '-' when (l.pos >> h.level) & 1 = 1 then 'L' || s.node else 'R' || s.node end step
  from leaves l join (select distinct g, level from tree where n > 1) h using (g) left join tree s on s.g = l.g and s.level = h.level and s.pos = xor(l.pos >> h.level, 1)
  union all select e.g, null, 1000 + h.level, case when s.node is null then '-' when (e.pos >> h.level) & 1 = 1 then 'L' || s.node else 'R' || s.node end
  from ends e join (select distinct level from crown where n > 1) h on true left join crown s on s.level = h.level and s.pos = xor(e.pos >> h.level, 1)),
own as (select g, pos, list(step order by level) steps from step where pos is not null group by g, pos),
shared as (select g, list(step order by level) steps from step where pos is null group by g),
paths as (select doc_id, leaf, altered, subroot, (select node from crown where n = 1) root, list_concat(coalesce(o.steps, []), coalesce(h.steps, [])) steps
  from leaves l join ends using (g) left join own o on o.g = l.g and o.pos = l.pos left join shared h on h.g = l.g),
done as (select *, sha256(coalesce(list_aggregate(list_transform(steps, lambda x: x[2:]), 'string_agg', ''), '')) proof_sha256,
  list_reduce(list_prepend(altered, steps), lambda a, x: sha256(case x[1] when 'L' then x[2:] || a when 'R' then a || x[2:] else a end)) folded_root from paths)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root verified from done"""

ORACLES: dict[str, str] = {"op10_vector_topk": TOP_K, "op7_mixing": MIXING, "op5_near_dedup": NEAR, "op11_resample": RESAMPLE, "op13_merkle": MERKLE}
