"""Registered queries, one for each operator, over the driver's tables; with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.functions import ids, language, patches, paths, text, times, tokens
from usagelake.functions.ids import COUNTERS
from usagelake.operators import dedupe, files, identity, order, precedence, queue, sequence, summary
from usagelake.plans import adapters as a

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KS = "ks as (select *, json_extract_string(props, '$.k')::bigint k from events)"
USAGE = f"""{KS}, usage as (select event_type provider, event_id seq, ts, strftime(ts, '%Y-%m-%d') date, k, 'p' || (k % 7)::varchar project,
 '/work/p' || (k % 7)::varchar project_path, 's' || user_id::varchar session_id, floor(value)::bigint input_tokens, k output_tokens,
 0::bigint cache_creation_input_tokens, k % 5 cache_read_input_tokens, 0::bigint cached_input_tokens, k % 3 reasoning_output_tokens,
 floor(value)::bigint + k + k % 5 + k % 3 total_tokens from ks)"""
COUNTER = f"""{KS}, c0 as (select event_id, user_id, event_type, case when event_id % 4 = 0 then 0 else k end k from ks),
 c1 as (select *, sum((event_type = 'error')::int) over (partition by user_id order by event_id)::bigint epoch from c0),
 counter as (select user_id, event_id, event_type, k, epoch, (sum(k) over (partition by user_id, epoch order by event_id))::bigint running from c1)"""
PATCHES = """patches as (select l_orderkey entry, l_linenumber, l_partkey, l_suppkey, l_shipdate, 'src/f' || (l_partkey % 20)::varchar || case l_suppkey % 5 when 0 then '.go' when 1 then '.py' when 2 then '.h' when 3 then '.cpp' else '.md' end path,
 l_quantity::bigint lines_added, l_linenumber::bigint lines_removed from lineitem)"""
QUEUE = f"""queue as (select o_orderkey::varchar id, epoch(o_orderdate)::bigint ts, case o_custkey % 5 when 0 then 'pending' when 1 then 'failed' when 2 then 'sending' when 3 then 'uploaded' else 'rejected' end status,
 (o_custkey % 10)::int attempt_count, {a.NOW} + (o_custkey % 7 - 3) * 100 next_attempt_at, case when o_custkey % 5 = 3 then epoch(o_orderdate)::bigint end uploaded_at,
 case when o_custkey % 5 = 2 then {a.NOW} + (o_custkey % 3 - 1) * 10 else 0 end lease_until from orders)"""
TRANSCRIPT = """t0 as (select conv_id, turn, role, length(coalesce(text, ''))::bigint n from conversations),
 transcript as (select conv_id, turn, role, min(n) n, min(case when n % 3 = 0 then 'm' || (n % 4)::varchar else '' end) model,
 turn * 4 + case role when 'user' then 0 when 'assistant' then 1 else 2 end "at" from t0 group by conv_id, turn, role)"""


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


@query(f"with {USAGE} select provider, date, project, project_path, {', '.join(f'sum({c})::bigint {c}' for c in COUNTERS)} from usage group by all")
def daily_project_summary(spark, sf_dir):
    return summary.daily_project_summary(a.usage_events(spark, sf_dir))


@query(f"with {USAGE} select date, project, sum(input_tokens + output_tokens + cache_read_input_tokens)::bigint total_tokens, count(*) entries from usage where provider = 'click' group by all")
def daily_totals(spark, sf_dir):
    return summary.daily_totals(a.usage_events(spark, sf_dir).where("provider = 'click'"))


@query(f"with {USAGE} select provider, session_id, sum(total_tokens)::bigint total_tokens, count(*) events from usage where total_tokens > 0 group by all")
def session_token_totals(spark, sf_dir):
    rows = a.usage_events(spark, sf_dir).where(tokens.non_zero(F.col("usage")))
    return rows.groupBy("provider", "session_id").agg(F.sum("usage.total_tokens").cast("long").alias("total_tokens"), F.count("*").alias("events"))


@query(f"with {USAGE} select session_id, k, seq from usage qualify row_number() over (partition by session_id, k order by seq) = 1")
def dedupe_first_wins(spark, sf_dir):
    return dedupe.first_wins(a.usage_events(spark, sf_dir).select("session_id", "k", "seq"), ["session_id", "k"], ["seq"])


@query(f"with {USAGE} select session_id, k, seq, min(seq) over (partition by session_id, k) position from usage qualify row_number() over (partition by session_id, k order by seq desc) = 1")
def dedupe_last_wins(spark, sf_dir):
    return dedupe.last_wins(a.usage_events(spark, sf_dir).select("session_id", "k", "seq"), ["session_id", "k"], ["seq"])


@query(f"""with {USAGE} select session_id, m, seq, total_tokens from (select *, case when k % 11 = 0 then null else k % 11 end m from usage)
 qualify row_number() over (partition by session_id, m order by total_tokens desc, (provider = 'view') desc, seq) = 1""")
def dedupe_keep_best(spark, sf_dir):
    rows = a.usage_events(spark, sf_dir).select("session_id", F.when(F.col("k") % 11 != 0, F.col("k") % 11).alias("m"), "seq", "provider", F.col("usage.total_tokens").alias("total_tokens"))
    return dedupe.keep_best(rows, ["session_id", "m"], F.col("total_tokens"), F.col("provider") == "view", ["seq"]).drop("provider")


@query(f"with {QUEUE} select id, ts from queue where id::bigint % 3 <> 0 union all select 'new-' || o_custkey::varchar, max(epoch(o_orderdate))::bigint from orders where o_custkey % 2 = 0 group by o_custkey")
def insert_ignore(spark, sf_dir):
    q = a.queue(spark, sf_dir).select("id", "ts")
    new = a.read(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.concat(F.lit("new-"), F.col("o_custkey").cast("string")).alias("id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("ts")).withColumn("neg", -F.col("ts"))
    stored = q.where("id % 3 = 0")
    return dedupe.insert_ignore(stored, q.withColumn("neg", -F.col("ts")).unionByName(new), "id", ["neg"]).drop("neg")


@query(f"""with {QUEUE} select new_id, status, id from (select *, 'k' || (id::bigint % 500)::varchar new_id from queue)
 qualify row_number() over (partition by new_id order by case status when 'uploaded' then 3 when 'rejected' then 2 else 1 end desc, ts, id) = 1""")
def rekey_status_rank(spark, sf_dir):
    q = a.queue(spark, sf_dir).withColumn("new_id", F.concat(F.lit("k"), (F.col("id").cast("long") % 500).cast("string")))
    return dedupe.rekey(q, "new_id", "status", ["ts", "id"]).select("new_id", "status", "id")


@query(f"""with {COUNTER}, p as (select *, lag(running) over (partition by user_id order by event_id) prev from counter)
 select user_id, event_id, case when prev is null or running >= prev then running - coalesce(prev, 0) else k end billed from p where prev is null or running <> prev""")
def counter_delta(spark, sf_dir):
    c = a.counter_events(spark, sf_dir).select("user_id", "event_id", F.struct(F.col("running").alias("x")).alias("total"), F.struct(F.col("k").alias("x")).alias("last"))
    return sequence.counter_deltas(c, ["user_id"], ["event_id"], "total", "last", ["x"]).select("user_id", "event_id", F.col("delta.x").alias("billed"))


@query(f"""with {COUNTER}, p as (select *, lag(running) over (partition by user_id order by event_id) prev from counter where running > 0)
 select user_id, event_id, case when prev is null or running <= prev then running else running - prev end billed from p""")
def running_growth_billing(spark, sf_dir):
    c = a.counter_events(spark, sf_dir).where("running > 0")
    return c.select("user_id", "event_id", sequence.growth(F.col("running"), ["user_id"], ["event_id"]).alias("billed"))


@query(f"""with {TRANSCRIPT} select conv_id, "at", coalesce(last_value(nullif(model, '') ignore nulls) over (partition by conv_id order by "at" rows between unbounded preceding and current row), '') model,
 coalesce(last_value(nullif(model, '') ignore nulls) over (partition by conv_id order by "at" rows between unbounded preceding and unbounded following), '') final_model from transcript""")
def carry_forward_model(spark, sf_dir):
    t = a.transcript(spark, sf_dir)
    return t.select("conv_id", "at", sequence.carried(F.col("model"), ["conv_id"], ["at"]).alias("model"), sequence.final_value(F.col("model"), ["conv_id"], ["at"]).alias("final_model"))


OWN = """case when role = 'assistant' then "at" end"""
UP = """over (partition by conv_id order by "at" rows between unbounded preceding and current row)"""
DOWN = """over (partition by conv_id order by "at" rows between current row and unbounded following)"""


@query(f"""with {TRANSCRIPT}, x as (select *, coalesce(last_value({OWN} ignore nulls) {UP}, first_value({OWN} ignore nulls) {DOWN}) target from transcript)
 select conv_id, "at", target from x where role = 'user'""")
def asof_patch_attribution(spark, sf_dir):
    t = a.transcript(spark, sf_dir).withColumn("target", sequence.attributed_to(F.col("role") == "assistant", F.col("at"), ["conv_id"], ["at"]))
    return t.where("role = 'user'").select("conv_id", "at", "target")


@query(f"""with {TRANSCRIPT}, x as (select *, first_value({OWN} ignore nulls) {DOWN} target from transcript)
 select conv_id, target, sum(n)::bigint n from x where role = 'user' and target is not null group by all""")
def fold_into_next_emitted(spark, sf_dir):
    t = a.transcript(spark, sf_dir).withColumn("target", sequence.attributed_to(F.col("role") == "assistant", F.col("at"), ["conv_id"], ["at"], following_only=True))
    return t.where("role = 'user' and target is not null").groupBy("conv_id", "target").agg(F.sum("n").cast("long").alias("n"))


@query(f"""with {KS}, l as (select event_id, user_id, ts from ks where event_type = 'purchase'), r as (select event_id rid, user_id, ts from ks where event_type = 'view'),
 p as (select l.event_id, max(rid) filter (where r.ts <= l.ts) before_, min(rid) first_ from l left join r using (user_id) group by all)
 select event_id, coalesce(before_, first_) call_id from p""")
def asof_first_following(spark, sf_dir):
    e = a.read(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("rid"))
    return sequence.as_of(e.where("event_type = 'purchase'").drop("event_type"), views, ["user_id"], "ts", "ts", "rid", "rid", "call_id").select("event_id", "call_id")


ROLLUP = f"""{PATCHES}, n as (select *, row_number() over (partition by entry order by l_linenumber, l_partkey, l_suppkey, l_shipdate) at_ from patches),
 f as (select entry, path, sum(lines_added)::bigint added, sum(lines_removed)::bigint removed, min(at_) first_ from n group by all)"""


@query(f"with {ROLLUP} select entry, sum(added)::bigint lines_added, sum(removed)::bigint lines_removed, string_agg(path, ',' order by first_) files from f group by entry")
def file_change_rollup(spark, sf_dir):
    r = files.file_rollup(a.patches(spark, sf_dir), ["entry"], a.PATCH_ORDER)
    return r.select("entry", "lines_added", "lines_removed", F.array_join(F.transform("files", lambda f: f["path"]), ",").alias("files"))


@query(f"with {ROLLUP} select entry, path entity from f qualify row_number() over (partition by entry order by added + removed desc, first_ desc) = 1")
def most_changed_entity_last(spark, sf_dir):
    return files.file_rollup(a.patches(spark, sf_dir), ["entry"], a.PATCH_ORDER).select("entry", "entity")


@query(f"with {ROLLUP} select entry, path entity from f qualify row_number() over (partition by entry order by added + removed desc, first_) = 1")
def most_changed_entity_first(spark, sf_dir):
    return files.file_rollup(a.patches(spark, sf_dir), ["entry"], a.PATCH_ORDER, tie="first").select("entry", "entity")


LANGUAGES = f"""{PATCHES}, s as (select entry, case split_part(path, '.', 2) when 'go' then 'Go' when 'py' then 'Python' when 'cpp' then 'C++' when 'md' then 'Markdown' else '.h' end language, sum(greatest(lines_added, 1))::bigint w from patches group by all),
 fixed as (select s.entry, case when language = '.h' then case when exists (select 1 from s c where c.entry = s.entry and c.language = 'C++') then 'C++' else 'C' end else language end language, w from s),
 t as (select entry, language, sum(w)::bigint w from fixed group by all)"""


@query(f"with {LANGUAGES} select entry, language from t qualify row_number() over (partition by entry order by w desc, language) = 1")
def dominant_language(spark, sf_dir):
    return files.dominant_language(a.patches(spark, sf_dir).withColumnRenamed("lines_added", "weight"), ["entry"])


@query(f"""with {KS}, r as (select event_id, user_id, case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 else 4 end level,
  case when k % 10 < 3 then '' else 't' || (k % 10)::varchar end trace_id, case when k % 9 < 5 then '' else 'r' || (k // 5)::varchar end response_id from ks)
 select event_id, level from r x where (trace_id = '' or not exists (select 1 from r y where y.user_id = x.user_id and y.trace_id = x.trace_id and y.level < x.level))
 and (response_id = '' or not exists (select 1 from r y where y.user_id = x.user_id and y.response_id = x.response_id and y.level < x.level))""")
def precedence_suppression(spark, sf_dir):
    e = a.k_of(a.read(spark, sf_dir, "events"))
    level = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 3).otherwise(4)
    trace = F.when(F.col("k") % 10 < 3, "").otherwise(F.concat(F.lit("t"), (F.col("k") % 10).cast("string")))
    response = F.when(F.col("k") % 9 < 5, "").otherwise(F.concat(F.lit("r"), F.floor(F.col("k") / 5).cast("string")))
    rows = e.select("event_id", "user_id", level.alias("level"), trace.alias("trace_id"), response.alias("response_id"))
    return precedence.suppress_lower(rows, ["user_id"], ["trace_id", "response_id"], "level").select("event_id", "level")


@query(f"""with {KS}, a as (select event_id, user_id, k, ts from ks where event_id % 2 = 0), b as (select user_id, k, ts + interval 1 second * (event_id % 5) ts from ks where event_id % 6 = 0 or event_id % 2 = 1)
 select event_id from a where not exists (select 1 from b where a.user_id = b.user_id and a.k = b.k and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 2000000)""")
def tolerance_anti_join(spark, sf_dir):
    e = a.k_of(a.read(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    other = e.where("event_id % 6 = 0 or event_id % 2 = 1").withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 5 * 1_000_000))
    return precedence.without_twins(e.where("event_id % 2 = 0"), other, ["user_id", "k"], "ts", 2_000_000).select("event_id")


@query(f"""with {KS}, a as (select k id, event_id from ks where event_id % 2 = 0), b as (select k + 30 id, event_id from ks where event_id % 2 = 1),
 u as (select 0 f, * from a union all select 1 f, * from b) select id, event_id from u qualify row_number() over (partition by id order by f, event_id) = 1""")
def database_over_legacy(spark, sf_dir):
    e = a.k_of(a.read(spark, sf_dir, "events"))
    return precedence.preferred_union(e.where("event_id % 2 = 0").select(F.col("k").alias("id"), "event_id"), e.where("event_id % 2 = 1").select((F.col("k") + 30).alias("id"), "event_id"), ["id"], ["event_id"])


@query("select o_orderkey::bigint message, o_orderpriority role, coalesce(string_agg(l_partkey::varchar || '/' || l_suppkey::varchar, ',' order by l_linenumber, l_partkey, l_suppkey), '') parts from orders left join lineitem on l_orderkey = o_orderkey group by all")
def message_parts_join(spark, sf_dir):
    parts = a.read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    listed = parts.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("p"))
    joined = a.read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").join(listed, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.select(F.col("o_orderkey").alias("message"), F.col("o_orderpriority").alias("role"), F.coalesce(F.array_join(F.transform("p", lambda x: F.concat_ws("/", x["l_partkey"].cast("string"), x["l_suppkey"].cast("string"))), ","), F.lit("")).alias("parts"))


@query(f"""with {KS}, m as (select k id, max(event_id) last_ from ks where k <> 0 and event_type = 'click' group by k)
 select event_id, coalesce(last_, 0) cache_tokens from ks left join m on m.id = ks.k where event_type = 'purchase'""")
def ledger_cache_left_join(spark, sf_dir):
    e = a.k_of(a.read(spark, sf_dir, "events"))
    cache = e.where("k <> 0 and event_type = 'click'").groupBy(F.col("k").alias("id")).agg(F.max("event_id").alias("last_"))
    return e.where("event_type = 'purchase'").join(cache, F.col("k") == F.col("id"), "left").select("event_id", F.coalesce("last_", F.lit(0)).alias("cache_tokens"))


@query(f"with {QUEUE} select id from queue where status = 'sending' and id::bigint % 4 not in (0, 1, 2)")
def unacknowledged_ids(spark, sf_dir):
    q = a.queue(spark, sf_dir)
    replies = [q.where(F.col("id").cast("long") % 4 == n).select("id") for n in (0, 1, 2)]
    return precedence.unacknowledged(q.where("status = 'sending'").select("id"), *replies)


@query(f"with {QUEUE} select id, ts from queue where status in ('pending', 'failed') and next_attempt_at <= {a.NOW} order by ts desc, id limit 100")
def queue_due_topk(spark, sf_dir):
    return queue.due(a.queue(spark, sf_dir), a.NOW, 100).select("id", "ts")


@query(f"""with {QUEUE}, f as (select id, ts, 0 turn from queue where status in ('pending', 'failed') and next_attempt_at <= {a.NOW}),
 s as (select id, ts, 1 turn from queue where status = 'sending' and lease_until <= {a.NOW}),
 c as (select id from (select * from f union all select * from s) order by turn, ts desc, id limit 3500)
 select id, case when id in (select id from c) then 'sending' else status end status, case when id in (select id from c) then {a.NOW} + 300 else lease_until end lease_until from queue""")
def queue_claim_topup(spark, sf_dir):
    return queue.claim(a.queue(spark, sf_dir), a.NOW, 3500)[1].select("id", "status", "lease_until")


@query(f"with {QUEUE} select id, case when status = 'sending' and id::bigint % 2 = 0 then 'pending' else status end status from queue")
def queue_release(spark, sf_dir):
    q = a.queue(spark, sf_dir)
    return queue.release(q, q.where("id % 2 = 0")).select("id", "status")


@query(f"""with {QUEUE} select id, case when h then 'failed' else status end status, case when h then attempt_count + 1 else attempt_count end attempt_count,
 case when h then {a.NOW} + least(30 * (1 << least(attempt_count, 7)), 3600) else next_attempt_at end::bigint next_attempt_at from (select *, id::bigint % 3 = 0 h from queue)""")
def queue_backoff(spark, sf_dir):
    q = a.queue(spark, sf_dir)
    return queue.mark_failed(q, q.where("id % 3 = 0"), a.NOW, "timeout").select("id", "status", "attempt_count", "next_attempt_at")


@query(f"""with {QUEUE} select id, case when id::bigint % 5 = 0 then 'rejected' when id::bigint % 3 = 0 then 'uploaded' else status end status,
 case when id::bigint % 3 = 0 then {a.NOW} else uploaded_at end uploaded_at from queue""")
def queue_mark_done(spark, sf_dir):
    q = a.queue(spark, sf_dir)
    return queue.mark_rejected(queue.mark_uploaded(q, q.where("id % 3 = 0"), a.NOW), q.where("id % 5 = 0"), "bad").select("id", "status", "uploaded_at")


@query(f"with {QUEUE} select id from queue where not (status = 'uploaded' and uploaded_at < {a.NOW} - 30 * 86400)")
def queue_prune(spark, sf_dir):
    return queue.prune(a.queue(spark, sf_dir), a.NOW).select("id")


@query(f"with {QUEUE} select count(*) pending from queue where status in ('pending', 'failed') and next_attempt_at <= {a.NOW}")
def pending_count(spark, sf_dir):
    return queue.pending_count(a.queue(spark, sf_dir), a.NOW)


@query("select coalesce(nullif(trim(case when o_custkey % 3 = 0 then ' ' else o_orderpriority end), ''), 'no reason given') reason, count(*) n from orders group by all")
def rejection_reason_counts(spark, sf_dir):
    o = a.read(spark, sf_dir, "orders", "o_custkey", "o_orderpriority")
    return queue.rejection_reasons(o.select(F.when(F.col("o_custkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("reason")))


@query("""with f as (select o_orderkey::varchar path, o_custkey size, 7::bigint mtime_ns from orders), s as (select o_orderkey::varchar path, o_custkey - o_orderkey % 3 size, 7::bigint mtime_ns, o_custkey - o_orderkey % 5 + 2 "offset" from orders where o_orderkey % 2 = 0)
 select f.path, f.size, f.mtime_ns, case when s.path is null or f.size < s."offset" then 0 else s."offset" end start from f left join s using (path)
 where not coalesce(f.size = s.size and f.mtime_ns = s.mtime_ns and s."offset" >= f.size, false)""")
def scan_state_skip(spark, sf_dir):
    o = a.read(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    found = o.select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").alias("size"), F.lit(7).cast("long").alias("mtime_ns"))
    state = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_custkey") - F.col("o_orderkey") % 3).alias("size"), F.lit(7).cast("long").alias("mtime_ns"), (F.col("o_custkey") - F.col("o_orderkey") % 5 + 2).alias("offset"))
    return queue.scan_work(found, state, resumable=True)


@query("""with p as (select page_id, '/' || regexp_replace(url, '^[a-z]+://', '') path from pages), m as (select distinct '/' || split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) dir from pages where page_id % 3 = 0),
 l as (select distinct '/' || split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) || '/' || split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 2) dir from pages where page_id % 2 = 0 and length(split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 3)) > 0),
 a as (select dir, 'a' mark from m union all select dir, 'b' from l)
 select page_id, dir, mark from p left join (select page_id, dir, mark from p join a on rtrim(path, '/') = dir or starts_with(path, dir || '/') qualify row_number() over (partition by page_id order by length(dir) desc) = 1) using (page_id)""")
def ancestor_identity_lookup(spark, sf_dir):
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    part = lambda n: F.split_part(bare, F.lit("/"), F.lit(n))
    p = a.read(spark, sf_dir, "pages", "page_id", "url")
    hosts = p.where("page_id % 3 = 0").select(F.concat(F.lit("/"), part(1)).alias("dir")).distinct().withColumn("mark", F.lit("a"))
    deeper = p.where("page_id % 2 = 0").where(F.length(part(3)) > 0).select(F.concat(F.lit("/"), part(1), F.lit("/"), part(2)).alias("dir")).distinct().withColumn("mark", F.lit("b"))
    rows = p.select("page_id", F.concat(F.lit("/"), bare).alias("path"))
    return precedence.nearest_ancestor(rows, F.col("path"), hosts.unionByName(deeper), ["page_id"]).select("page_id", "dir", "mark")


@query(f"""with {USAGE} select sha256(provider || chr(0) || 'events.jsonl' || chr(0) || seq::varchar || chr(0) || strftime(ts, '%Y-%m-%dT%H:%M:%S') || regexp_replace(regexp_replace('.' || lpad((epoch_us(ts) % 1000000)::varchar, 6, '0'), '0+$', ''), '\\.$', '') || 'Z' || chr(0) || project || chr(0) || project_path || chr(0) || session_id || chr(0) || '' || chr(0) || {" || chr(0) || ".join(f"{c}::varchar" for c in COUNTERS)}) id, seq from usage""")
def stable_event_id(spark, sf_dir):
    rows = a.usage_events(spark, sf_dir).withColumn("source_file", F.lit("events.jsonl")).withColumn("source_start", F.col("seq")).withColumn("model", F.lit(""))
    return rows.select(ids.stable_entry_id().alias("id"), "seq")


@query(f"with {USAGE} select seq, case when project_path = '' then '' else sha256(project_path) end project_path_hash from usage")
def project_path_hash(spark, sf_dir):
    return a.usage_events(spark, sf_dir).select("seq", text.hash_project_path(F.col("project_path")).alias("project_path_hash"))


@query(f"""with {USAGE} select seq, case when seq % 3 = 0 then 'src/a' || (seq % 4)::varchar || '.go' when seq % 3 = 1 then 'b.py' else 'c.md' end entity from usage""")
def relative_entity(spark, sf_dir):
    u = a.usage_events(spark, sf_dir)
    inside = F.concat(F.col("project_path"), F.lit("/./src/x/../a"), (F.col("seq") % 4).cast("string"), F.lit(".go"))
    entity = F.when(F.col("seq") % 3 == 0, inside).when(F.col("seq") % 3 == 1, F.lit("/elsewhere/b.py")).otherwise(F.lit("docs/c.md"))
    return u.select("seq", paths.relative_entity(F.col("project_path"), entity).alias("entity"))


@query("""select page_id, case when length(url) % 4 = 0 then '/a/c/d' when length(url) % 4 = 1 then '../x' when length(url) % 4 = 2 then '.' else '/' end cleaned, case when length(url) % 4 = 0 then 'd' when length(url) % 4 = 1 then 'x' when length(url) % 4 = 2 then '..' else '/' end base_,
 case when length(url) % 4 = 0 then '/w/a/c/d' when length(url) % 4 = 1 then '/x' when length(url) % 4 = 2 then '/w' else '/' end resolved from pages""")
def clean_paths(spark, sf_dir):
    n = F.length("url") % 4
    path = F.when(n == 0, "/a/./b/../c//d").when(n == 1, "a/../../x").when(n == 2, "a/..").otherwise("/..")
    path = path.cast("string")
    cwd = F.when(n == 0, "/w/").otherwise("/w")
    joined = F.when(n == 0, paths.join(cwd, F.substring(path, 2, 99))).otherwise(paths.resolve_path(cwd, path))
    return a.read(spark, sf_dir, "pages", "page_id", "url").select("page_id", paths.clean(path).alias("cleaned"), F.when(n == 3, paths.base(F.lit("/"))).otherwise(paths.base(path)).alias("base_"), joined.alias("resolved"))


@query("""with e as (select event_id, event_type, case event_id % 7 when 0 then 'claude-vscode' when 1 then ' CLI ' when 2 then 'sdk-ts' when 3 then 'codex_vscode' when 4 then 'Codex Desktop' when 5 then ' Other ' else '' end token, case when event_id % 2 = 0 then 'claude' else 'codex' end provider from events)
 select event_id, case when provider = 'claude' and lower(trim(token)) = 'claude-vscode' then 'VS Code' when provider = 'claude' and lower(trim(token)) = 'cli' then 'Claude CLI' when provider = 'claude' and token = 'sdk-ts' then 'Claude SDK'
 when provider = 'codex' and token = 'codex_vscode' then 'VS Code' when provider = 'codex' and lower(token) = 'codex desktop' then 'Codex Desktop' when provider = 'codex' and lower(trim(token)) = 'cli' then 'Codex CLI' else trim(token) end client from e""")
def normalize_client(spark, sf_dir):
    token = F.element_at(F.array(*[F.lit(x) for x in ("claude-vscode", " CLI ", "sdk-ts", "codex_vscode", "Codex Desktop", " Other ", "")]), (F.col("event_id") % 7 + 1).cast("int"))
    provider = F.when(F.col("event_id") % 2 == 0, "claude").otherwise("codex")
    return a.read(spark, sf_dir, "events", "event_id").select("event_id", text.normalize_client(provider, token).alias("client"))


@query("select event_id, case event_id % 4 when 0 then 'Unknown' when 1 then 'Unknown' when 2 then event_type else 'Unknown' end project, case event_id % 4 when 0 then 'Unknown' when 3 then 'Unknown' else event_type end as language from events")
def normalize_project(spark, sf_dir):
    n = F.col("event_id") % 4
    project = F.when(n == 0, "").when(n == 1, " unKNOWN ").when(n == 2, F.concat(F.lit(" "), F.col("event_type")))
    language_ = F.when(n == 0, " ").when(n != 3, F.col("event_type"))
    return a.read(spark, sf_dir, "events", "event_id", "event_type").select("event_id", text.normalize_project(project).alias("project"), text.normalize_language(language_).alias("language"))


@query(f"with {KS}, r as (select event_id, case event_id % 5 when 0 then 1700000000 + k when 1 then (1700000000 + k) * 1000 when 2 then (1700000000 + k) * 1000000 when 3 then (1700000000 + k) * 1000000000 else 0 end raw, k from ks) select event_id, case when raw > 0 then 1700000000 + k end as seconds from r")
def timestamp_scalar(spark, sf_dir):
    n, base_ = F.col("event_id") % 5, F.col("k") + 1_700_000_000
    raw = F.when(n == 0, base_).when(n == 1, base_ * 1000).when(n == 2, base_ * 1_000_000).when(n == 3, base_ * 1_000_000_000).otherwise(0)
    return a.k_of(a.read(spark, sf_dir, "events")).select("event_id", F.unix_seconds(times.from_scalar(raw)).alias("seconds"))


@query(f"""with {KS}, r as (select event_id, k, case when event_id % 3 = 0 then 0 else k end i, case when event_id % 3 = 0 then 0 else k % 9 end o, case event_id % 4 when 0 then 0 else 90 end t from ks)
 select event_id, i input_tokens, case when i + o = 0 and t > 0 then t else o end output_tokens, case when i + o > 0 and t > i + o then t - i - o else 0 end::bigint reasoning_output_tokens, case when t > i + o then t else i + o end::bigint total_tokens from r""")
def total_fallback(spark, sf_dir):
    e = a.k_of(a.read(spark, sf_dir, "events"))
    part = lambda c: F.when(F.col("event_id") % 3 == 0, 0).otherwise(c)
    total = F.when(F.col("event_id") % 4 == 0, 0).otherwise(90).cast("long")
    u = tokens.apply_total(tokens.usage(part(F.col("k")), part(F.col("k") % 9)), total)
    return e.select("event_id", u.alias("u")).select("event_id", *[f"u.{c}" for c in ("input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")])


@query(f"with {KS} select event_id, case when event_id % 60 <= k then k - event_id % 60 else 0 end::bigint input_tokens, event_id % 60 cache_read_input_tokens, k % 9 output_tokens, (k + k % 9)::bigint total_tokens from ks")
def disjoint_token_buckets(spark, sf_dir):
    from usagelake.providers.stateful import codex_account

    cached, out = F.col("event_id") % 60, F.col("k") % 9
    counts = F.struct(F.col("k").alias("input_tokens"), cached.alias("cached_input_tokens"), out.alias("output_tokens"), F.lit(0).alias("reasoning_output_tokens"), (F.col("k") + out).alias("total_tokens"))
    u = a.k_of(a.read(spark, sf_dir, "events")).select("event_id", codex_account(counts).alias("u"))
    return u.select("event_id", *[f"u.{c}" for c in ("input_tokens", "cache_read_input_tokens", "output_tokens", "total_tokens")])


@query(f"with {KS} select event_id, case when k % 4 <> 0 then k % 4 when k % 5 <> 0 then k % 5 else 0 end n, case event_id % 6 when 0 then 12 when 1 then 12 when 2 then 9223372036854775807 when 5 then 1000 else 0 end::bigint c from ks")
def alias_first_positive(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("12", " 12.9 ", "18446744073709551615", "-3", "x", "1e3")]), (F.col("event_id") % 6 + 1).cast("int"))
    return a.k_of(a.read(spark, sf_dir, "events")).select("event_id", tokens.first_positive(F.col("k") % 4, F.col("k") % 5).alias("n"), tokens.counter(raw).alias("c"))


@query(f"""with {KS} select event_id, case when k % 3 = 2 then null else k * 2 end input_tokens, case when k % 3 = 2 then null else k end output_tokens from ks""")
def token_details_split(spark, sf_dir):
    from usagelake.functions.details import split_details

    kinds = F.array(F.struct(F.lit("input").alias("tokenType"), F.col("k").alias("count")), F.struct(F.when(F.col("k") % 3 == 2, "odd").otherwise("input").alias("tokenType"), F.col("k").alias("count")), F.struct(F.lit("output").alias("tokenType"), F.col("k").alias("count")))
    d = a.k_of(a.read(spark, sf_dir, "events")).select("event_id", split_details(kinds).alias("d"))
    return d.select("event_id", "d.input_tokens", "d.output_tokens")


@query("select doc_id, case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + case when text like '%' || chr(10) then 0 else 1 end end::bigint lines from documents")
def count_lines(spark, sf_dir):
    return a.read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.count_lines(F.col("text")).alias("lines"))


@query("select doc_id, case when doc_id % 2 = 0 then '/r/x' || (doc_id % 9)::varchar || '.go,b.tsx' else 'lib/y.py' end paths from documents")
def paths_from_text(spark, sf_dir):
    even = F.concat(F.lit("see `/r/x"), (F.col("doc_id") % 9).cast("string"), F.lit(".go`, (b.tsx) and c.unknownext or b.tsx."))
    line = F.when(F.col("doc_id") % 2 == 0, even).otherwise(F.lit('edit "lib/y.py": done'))
    return a.read(spark, sf_dir, "documents", "doc_id").select("doc_id", F.array_join(language.paths_from_text(line), ",").alias("paths"))


@query(f"with {PATCHES} select distinct path, case split_part(path, '.', 2) when 'go' then 'Go' when 'py' then 'Python' when 'cpp' then 'C++' when 'md' then 'Markdown' else 'C' end as language from patches")
def language_from_path(spark, sf_dir):
    return a.patches(spark, sf_dir).select("path").distinct().select("path", language.language_of(F.col("path")).alias("language"))


@query(f"with {PATCHES} select distinct path, 3::bigint lines_added, 1::bigint lines_removed from patches")
def envelope_changes(spark, sf_dir):
    body = F.concat(F.lit("note\n*** Begin Patch\n*** Update File: old\n*** Move to: "), F.col("path"), F.lit("\n@@\n+a\n+b\n-c\n keep\n*** End of File\n+d\n*** End Patch"))
    one = a.patches(spark, sf_dir).select("path").distinct().select(F.element_at(patches.envelope_changes(body), 1).alias("c"))
    return one.select("c.path", "c.lines_added", "c.lines_removed")


@query(f"""with {USAGE} select seq, provider, session_id, project, sha256(project_path) project_path_hash, case when input_tokens = 0 then -1 else input_tokens end input_tokens, output_tokens, total_tokens,
 'src/f' || (seq % 9)::varchar || '.py' entity, case when seq % 3 = 0 then 'f.go' end file, case when seq % 4 = 0 then -1 else seq % 4 end::bigint lines_added, false has_root from usage where output_tokens > 0""")
def wire_projection(spark, sf_dir):
    from usagelake.plans.export import wire_events
    from usagelake.schema import as_events

    rows = a.usage_events(spark, sf_dir).where("usage.output_tokens > 0").withColumn("id", F.col("seq").cast("string"))
    change = F.struct(F.lit("/elsewhere/f.go").alias("path"), (F.col("seq") % 4).alias("lines_added"), F.lit(0).cast("long").alias("lines_removed"))
    rows = rows.withColumns({"entity": F.concat("project_path", F.lit("/src/f"), (F.col("seq") % 9).cast("string"), F.lit(".py")), "files": F.when(F.col("seq") % 3 == 0, F.array(change)).otherwise(F.array().cast("array<struct<path:string,lines_added:bigint,lines_removed:bigint>>")), "lines_added": F.col("seq") % 4})
    events = wire_events(as_events(rows), "UTC")
    get = lambda path, kind="string": F.get_json_object("event", f"$.{path}").cast(kind)
    texts, counts = ("provider", "session_id", "project", "project_path_hash", "entity"), ("input_tokens", "output_tokens", "total_tokens", "lines_added")
    return events.select(F.col("id").cast("long").alias("seq"), *[get(c).alias(c) for c in texts], *[F.coalesce(get(c, "long"), F.lit(-1)).alias(c) for c in counts], get("files[0].path").alias("file"), F.col("event").contains("/work/").alias("has_root"))


@query(f"""with {USAGE} select provider, project, total_tokens, sessions, level from (select provider, project, sum(total_tokens)::bigint total_tokens, count(distinct session_id) sessions, grouping_id(provider, project)::bigint level from usage group by cube (provider, project))""")
def summary_cube(spark, sf_dir):
    return summary.summary_cube(a.usage_events(spark, sf_dir))


@query(f"with {USAGE} select provider, session_id, seq from usage qualify row_number() over (partition by provider, session_id order by ts desc, seq) = 1")
def latest_snapshots(spark, sf_dir):
    rows = a.usage_events(spark, sf_dir).withColumn("id", F.col("seq"))
    return summary.latest_snapshots(rows).select("provider", "session_id", "seq")


@query(f"""with {USAGE}, g as (select *, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by provider, project order by ts, seq)) > 1800000000, true)::int first_ from usage),
 n as (select *, sum(first_) over (partition by provider, project order by ts, seq rows between unbounded preceding and current row) window_ from g)
 select provider, project, min(epoch_us(ts)) start_us, max(epoch_us(ts)) + 1800000000 end_us, count(*) events, sum(total_tokens)::bigint total_tokens from n group by provider, project, window_""")
def session_windows(spark, sf_dir):
    w = summary.session_windows(a.usage_events(spark, sf_dir))
    return w.select("provider", "project", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events", "total_tokens")


@query(f"with {USAGE} select seq, provider from usage order by ts desc, lpad(seq::varchar, 12, '0') limit 250")
def newest_entries(spark, sf_dir):
    rows = a.usage_events(spark, sf_dir).withColumn("id", F.lpad(F.col("seq").cast("string"), 12, "0"))
    return order.newest_first(rows).limit(250).select("seq", "provider")


@query(f"with {USAGE} select seq, provider from usage where provider = 'view' order by ts, lpad(seq::varchar, 12, '0') limit 250")
def oldest_entries(spark, sf_dir):
    rows = a.usage_events(spark, sf_dir).where("provider = 'view'").withColumn("id", F.lpad(F.col("seq").cast("string"), 12, "0"))
    return order.oldest_first(rows).limit(250).select("seq", "provider")


@query("""with sup as (select s_suppkey sk, '/w/n' || s_nationkey || '/s' || s_suppkey dir, s_nationkey nk from supplier),
 marks as (select dir, sk % 3 <> 0 identity, case sk % 5 when 0 then '' when 1 then 'team ' || sk when 2 then nk || '/{project}' when 3 then '{project}-{project}' else ' ' end said, case when sk % 2 = 0 then 'release/' || sk else '' end branch, sk % 7 = 1 broken, sk % 4 = 1 vcs from sup
  union all select '/w/n' || n_nationkey, n_nationkey % 2 = 0, 'all of {project}', '', n_nationkey % 10 = 4, n_nationkey % 3 = 0 from nation union all select '/w/own', true, 'shared', 'main', false, false
  union all select distinct dir || '/p' || (p_partkey % 3), false, '', '', false, true from sup join part on p_partkey % 50 = sk % 50),
 e as (select *, case when l_linenumber % 4 = 0 then '/plans/o' || l_orderkey % 9 when l_linenumber % 4 = 1 then '' else dir || '/p' || l_partkey % 3 || '/src' end a, case when l_orderkey % 5 = 0 then '/w/own/x' when l_orderkey % 5 = 1 then '' when l_orderkey % 5 = 2 then '' else dir end b,
  case when l_orderkey % 5 = 2 then 'w/own' when l_orderkey % 5 = 0 then '/w/own/x' when l_orderkey % 5 = 1 then '' else dir end old from lineitem join sup on sk = l_suppkey),
 st as (select distinct a start from e union select distinct b from e),
 near as (select start, (select arg_max(struct_pack(dir, said, branch, broken), length(dir)) from marks m where m.identity and (start = m.dir or starts_with(start, m.dir || '/'))) i, (select arg_max(dir, length(dir)) from marks m where m.vcs and (start = m.dir or starts_with(start, m.dir || '/'))) repo from st where start <> ''),
 x as (select e.*, case when na.i is not null then na.i else nb.i end i, case when na.i is not null then na.repo else nb.repo end repo from e left join near na on na.start = a left join near nb on nb.start = b),
 y as (select *, i is not null and not i.broken found, split_part(i.dir, '/', -1) own, replace(trim(case when trim(i.said) = '' then split_part(i.dir, '/', -1) else i.said end), '{project}', split_part(coalesce(repo, i.dir), '/', -1)) name from x)
 select case when found then name else 'old' end project, case when found then i.dir else old end project_path, case when found and i.branch <> '' then i.branch when found then 'b' else ' b' end branch, count(*) events, sum(l_quantity)::bigint quantity from y group by all""")
def project_identity(spark, sf_dir):
    """Events of lineitem in trees of supplier, whose folders and those above and below are marked by rule."""
    s = a.read(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").withColumn("dir", F.concat(F.lit("/w/n"), "s_nationkey", F.lit("/s"), "s_suppkey"))
    sk, nk, n = F.col("s_suppkey"), F.col("s_nationkey"), F.col("n_nationkey")
    said = F.element_at(F.array(F.lit(""), F.concat(F.lit("team "), sk), F.concat(nk, F.lit("/{project}")), F.lit("{project}-{project}"), F.lit("")), (sk % 5 + 1).cast("int"))
    row = lambda d, i, p, b, broken, vcs: [d.alias("dir"), i.alias("identity"), p.alias("said_project"), b.alias("said_branch"), broken.alias("broken"), vcs.alias("vcs")]
    none, no, yes = F.lit(""), F.lit(False), F.lit(True)
    # Of all parts only these remainders matter; joined one by one, pairs of parts and suppliers would grow with the square of the tables.
    kinds = a.read(spark, sf_dir, "part", "p_partkey").select((F.col("p_partkey") % 50).alias("of"), (F.col("p_partkey") % 3).alias("p")).distinct()
    below = s.join(kinds, F.col("of") == sk % 50).select(F.concat("dir", F.lit("/p"), "p").alias("dir")).distinct()
    marks = s.select(*row(F.col("dir"), sk % 3 != 0, said, F.when(sk % 2 == 0, F.concat(F.lit("release/"), sk)).otherwise(""), sk % 7 == 1, sk % 4 == 1))
    marks = marks.unionAll(a.read(spark, sf_dir, "nation").select(*row(F.concat(F.lit("/w/n"), n), n % 2 == 0, F.lit("all of {project}"), none, n % 10 == 4, n % 3 == 0)))
    marks = marks.unionAll(spark.range(1).select(*row(F.lit("/w/own"), yes, F.lit("shared"), F.lit("main"), no, no))).unionAll(below.select(*row(F.col("dir"), no, none, none, no, yes)))
    e = a.read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").join(s, F.col("l_suppkey") == sk)
    line, order_ = F.col("l_linenumber") % 4, F.col("l_orderkey") % 5
    entity = F.when(line == 0, F.concat(F.lit("/plans/o"), F.col("l_orderkey") % 9, F.lit("/plan.md"))).when(line == 1, F.lit("main.py")).otherwise(F.concat("dir", F.lit("/p"), F.col("l_partkey") % 3, F.lit("/./src/a.py")))
    path = F.when(order_ == 0, "/w/own/x").when(order_ == 1, "").when(order_ == 2, "w/own").otherwise(F.col("dir"))
    events = e.select(entity.alias("entity"), path.alias("project_path"), F.lit("old").alias("project"), F.lit(" b").alias("branch"), "l_quantity")
    rows = identity.with_identity(events, marks)
    return rows.groupBy("project", "project_path", "branch").agg(F.count("*").alias("events"), F.sum("l_quantity").cast("long").alias("quantity"))
