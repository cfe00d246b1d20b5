"""The registered queries of this folder, and SQL statements where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}

END_ID = 2


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """The tokenizer file of the queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettermill.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), word_tokenizer())


@_query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettermill.llm.tokenfile import round_trip

    return round_trip(table(spark, sf_dir, "documents"), word_tokenizer(), END_ID)


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettermill.llm.simhash import near_copies, to_hex

    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", to_hex().alias("fingerprint"), "component_id")


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each labelled document: 2 if good, 0.5 if not; all others weigh 1."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return labels.where("quality is not null").select(
        "doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


@_query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettermill.llm.mixing import mix

    picks = mix(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))
    return picks.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


STATEMENTS["op8_source_mix"] = r"""
with sized as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) as size,
    coalesce(l.weight, 1.0) as weight,
    (cast('0x' || substr(md5('mix:' || coalesce(cast(d.doc_id as varchar), '')), 1, 13) as bigint) + 0.5)
      / 4503599627370496.0 as u
  from documents d left join (
    select doc_id, case when max(quality) = 1 then 2.0 else 0.5 end as weight
    from labels where quality is not null group by doc_id) l using (doc_id)),
sources as (
  select source, sum(size) as source_size,
    [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3) + 1] as w
  from sized group by source),
shared as (
  select *, 2.0 * source_size as cap, 1.5 * sum(source_size) over () as total,
    coalesce(sum(2.0 * source_size) over f, 0) as held, sum(w) over r as open
  from sources
  window f as (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding),
    r as (order by source_size / w, source nulls last rows between current row and unbounded following)),
level as (
  select min(total - held) as room, min(open) as open from (
    select total, held, open, row_number() over (order by source_size / w, source nulls last) as k
    from shared where cap >= (total - held) * w / open) where k = 1),
targets as (
  select s.source, s.source_size::bigint as source_size,
    case when l.room is null or s.cap < l.room * s.w / l.open then s.cap else l.room * s.w / l.open end as target
  from shared s, level l),
ranked as (
  select z.doc_id, z.size, t.source_size, t.target,
    case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as epochs,
    coalesce(sum(z.size) over (partition by z.source order by -ln(z.u) / z.weight, z.doc_id, z.size
      rows between unbounded preceding and 1 preceding), 0) as before
  from sized z join targets t on z.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target::double as target,
  (size * (epochs + case when before + size / 2.0 <= target - epochs * source_size then 1 else 0 end))::bigint as taken
from ranked
"""


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettermill.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), toxicity.fold_out())
    return toxicity.score(docs, lexicon, toxicity.fold_out())


@_query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettermill.llm import langid

    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(~langid.fold_out()), threshold=False)
    return langid.predict(docs, profiles, langid.fold_out())


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettermill.llm import quality

    docs = table(spark, sf_dir, "documents")
    trees = quality.learn(docs, table(spark, sf_dir, "labels"), quality.fold_out())
    return quality.score(docs, trees, quality.fold_out())


@_query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettermill.llm.fingerprint import edited_likeness

    return edited_likeness(table(spark, sf_dir, "documents"))


@_query
def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettermill.llm.onebit import build_index, search, usable

    rows = table(spark, sf_dir, "embeddings")
    queries = usable(rows, "vec_id", "embedding").where(F.col("vec_id") % 20 == 0)
    return search(build_index(rows), queries)


TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", True), "after": ("integer", False)},
    "lookup": {"query": ("string", True), "limit": ("number", False), "after": ("integer", True)},
    "compute": {"query": ("string", True), "limit": ("integer", False)},
}
_CALLS = r"""
select conv_id, turn, cast(conv_id as {S}) || '-' || cast(turn as {S}) as call_id,
  case n % 3 when 0 then 'search' when 1 then 'lookup' else 'compute' end as tool,
  case when n % 11 = 0 then '{"limit": '
    when n % 7 = 0 then concat('{ "query": 5, "limit": ', cast(n as {S}), ' }')
    else concat('{"query": "', coalesce(regexp_extract(text, '([A-Za-z]+)', 1), ''), '", "limit": ', cast(n as {S}),
      ', "after": ', cast(turn as {S}), '}') end as arguments,
  case when n % 4 = 0 then cast(conv_id as {S}) || '-' || cast(turn - 2 as {S})
    when n % 20 = 5 then cast(conv_id as {S}) || '-' || cast(turn + 2 as {S}) end as depends
from (select *, coalesce(length(text), 0) as n from {T} where role = 'assistant') c
"""
_RESULTS = """
select conv_id, turn, cast(conv_id as {S}) || '-' || cast(turn - 1 as {S}) as call_id, text as content
from {T} where role is distinct from 'assistant'
"""


@_query
def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn as a tool call, and every other turn as the result of the turn before:
    opening turns are results without a call, turns without a number have no name."""
    from lettermill.llm.chat import link_tool_calls

    talk = table(spark, sf_dir, "conversations")
    view = f"talk_{uuid.uuid4().hex}"
    talk.createTempView(view)
    calls, results = (spark.sql(q.replace("{S}", "string").replace("{T}", view)) for q in (_CALLS, _RESULTS))
    spark.catalog.dropTempView(view)
    calls = calls.withColumn("depends", F.when(F.col("depends").isNotNull(), F.array("depends")))
    linked = link_tool_calls(calls, results, TOOLS)
    return linked.withColumn("faults", F.array_join("faults", "; "))


STATEMENTS["op10_tool_calls"] = (
    "with recursive calls as (" + _CALLS + "), results as (" + _RESULTS + r"""),
nodes as (
  select c.*, r.turn as answer, d.call_id as dep from calls c
  left join results r on r.conv_id = c.conv_id and r.call_id = c.call_id
  left join calls d on d.conv_id = c.conv_id and d.call_id = c.depends),
keys as (
  select conv_id, call_id, turn as seq, 0 as hop,
    case when answer is null or answer <= turn then turn else answer end as end_seq,
    case when answer is null then 0 when answer > turn then 0 else 1 end as end_hop
  from nodes where dep is null
  union all
  select conv_id, call_id, seq, hop,
    case when answer is null or answer <= seq then seq else answer end,
    case when answer is null then hop when answer > seq then 0 else hop + 1 end
  from (
    select n.conv_id, n.call_id, n.answer, greatest(n.turn, k.end_seq) as seq,
      case when n.turn > k.end_seq then 0 else k.end_hop + 1 end as hop
    from nodes n join keys k on k.conv_id = n.conv_id and k.call_id = n.dep) s),
checked as (
  select n.*, k.seq, k.hop,
    case when position('"after"' in arguments) > 0 then case when tool = 'compute' then 'unexpected after' else '' end
      when position('"query"' in arguments) > 0 then
        case when tool = 'lookup' then 'missing after; query is not string' else 'query is not string' end
      else 'not JSON' end as faults
  from nodes n left join keys k using (conv_id, call_id)),
events as (
  select conv_id, coalesce(seq, turn) as seq, coalesce(hop, 0) as hop, 'call' as kind, call_id, turn,
    case when call_id is null then 'unnamed' when seq is null then 'circular' when faults <> '' then 'invalid' when answer is null then 'unanswered'
      else 'ok' end as status, faults,
    case when faults = 'not JSON' then '{' else '{"arguments":{' ||
      case when position('"after"' in arguments) > 0 then '"after":' || turn || ',' else '' end ||
      '"limit":' || regexp_extract(arguments, '"limit": ([0-9]+)', 1) || ',"query":' ||
      regexp_extract(arguments, '"query": ("[^"]*"|[0-9]+)', 1) || '},' end ||
    '"call_id":"' || call_id || '","kind":"call",' ||
    case when faults = 'not JSON' then '"raw_arguments":' || to_json(arguments)::varchar || ',' else '' end ||
    '"tool":"' || tool || '"}' as message
  from checked
  union all
  select r.conv_id,
    case when k.seq is null then r.turn else greatest(r.turn, k.seq) end,
    case when k.seq is null or r.turn > k.seq then 0 else k.hop + 1 end, 'result', r.call_id, r.turn,
    case when r.call_id is null then 'unnamed' when c.call_id is null then 'orphan' when k.seq is null then 'circular' else 'ok' end, '',
    '{"call_id":"' || r.call_id || '",' || coalesce('"content":' || to_json(r.content)::varchar || ',', '') ||
      '"kind":"result"}'
  from results r left join calls c on c.conv_id = r.conv_id and c.call_id = r.call_id
  left join keys k on k.conv_id = r.conv_id and k.call_id = r.call_id)
select conv_id, row_number() over (partition by conv_id order by seq, hop, kind, call_id, turn, message) - 1 as place,
  kind, call_id, turn, status, faults, message
from events
""").replace("{S}", "varchar").replace("{T}", "conversations")


CENTROIDS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1


@_query
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettermill.llm import centroids

    found, means = centroids.cluster(table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS, DIM, SCALE,
                                     centroids.hashed_start(SEED))
    return centroids.with_inertia(found, means)


def _lloyd_sql() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} as materialized (
  select vec_id, list_min(list_transform(c.cs, lambda y: {{'d': list_sum(list_transform(list_zip(x, y.x),
    lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, 'c': y.cluster}})) as best, x
  from vecs, (select list({{'cluster': cluster, 'x': x}}) as cs from c{r}) c)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} as (
  select best.c as cluster, k, sum(x[k])::bigint as total, count(*) as n
  from (select best, x, unnest(range(1, {DIM + 1})) as k from a{r}) group by all),
c{r + 1} as materialized (
  select c.cluster, coalesce(m.x, c.x) as x from c{r} c left join (
    select cluster, list(((total - ((total % n) + n) % n) // n)::bigint order by k) as x from s{r} group by cluster) m
    using (cluster))""")
    return f"""
with vecs as materialized (
  select vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::double)::bigint) as x
  from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda v: v is not null and isfinite(v))) = {DIM}),
c0 as materialized (
  select (row_number() over (order by h, vec_id, x) - 1)::integer as cluster, x from (
    select *, sha256('{SEED}:' || vec_id) as h from vecs where vec_id is not null
    order by h, vec_id, x limit {CENTROIDS})),""" + ",".join(steps) + f"""
select vec_id, best.c as cluster, best.d as distance,
  (sum(best.d) over (partition by best.c))::bigint as cluster_inertia, (sum(best.d) over ())::bigint as inertia,
  sha256(array_to_string(m.x, ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} m on m.cluster = best.c
"""


STATEMENTS["op11_centroid_clusters"] = _lloyd_sql()


@_query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lettermill.llm.variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), every=97, shortest=5, least=3)


@_query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages count as captured in the order of their ids, a second apart."""
    from lettermill.llm.warc import round_trip

    captured = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("page_id"), F.lit(31_536_000)))
    return round_trip(table(spark, sf_dir, "pages"), captured).drop("url")


STATEMENTS["op13_warc"] = """
with hashed as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, coalesce(html, '') as html, sha1(coalesce(html, '')) as h
  from pages),
ranked as (
  select *, row_number() over w as nth, first_value(page_id) over w as first_id
  from hashed window w as (partition by html order by page_id nulls last))
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, ((i // 4) * 5 + 1)::integer, 5))::integer >> (15 - 5 * (i % 4))::integer) & 31) + 1)::integer, 1)), '')
    as payload_digest,
  case when nth = 1 then 'response' else 'revisit' end as record_type,
  case when nth > 1 then first_id end as refers_to
from ranked
"""
