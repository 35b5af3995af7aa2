"""Registered queries of the training-data operators, with DuckDB SQL where
SQL can express them.  Each query applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from reqlens.llm import (byte_bpe, chat_format, decontaminate, divergence_audit, html_extract, license_scan,
                         license_templates, metric_search, minhash, packing, quality_rules, secret_scan,
                         tokenizer_alignment, warc)

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_minhash_near_dedup", r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s from w),
x as (select doc_id, unnest(s) as g from sets),
hits as (select a.doc_id as a, b.doc_id as b, count(*) as n from x a join x b on a.g = b.g and a.doc_id < b.doc_id
         group by all),
links as (
  select a, b from hits join sets sa on sa.doc_id = a join sets sb on sb.doc_id = b
  where 100 * n >= 85 * (len(sa.s) + len(sb.s) - n)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as d, doc_id as r from documents
          union select reach.d, both_ways.b from reach join both_ways on both_ways.a = reach.r)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r) as component_id, s.doc_id = min(r) as kept
from sets s join reach on reach.d = s.doc_id group by s.doc_id, s.s
""")
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash near-duplicate groups of ``documents``."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), num=85)


#: Measurements and failed rules (``b``, in the order of their bits) of documents.
MEASURED_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from documents),
g as (select doc_id, i, array_to_string(w[i:i+2], ' ') as g
      from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t where len(w) >= 3)),
twice as (select doc_id, g from g group by all having count(*) > 1),
hit as (select distinct doc_id, i + unnest([0, 1, 2]) as i from g join twice using (doc_id, g)),
r as (select doc_id, count(*) as n from hit group by doc_id),
m as (
  select t.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(r.n, 0)::bigint as n_repeat_words,
         (length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')))::bigint as n_upper,
         (length(text) - length(regexp_replace(text, '\p{L}+', '', 'g')))::bigint as n_letters
  from t left join r on r.doc_id = t.doc_id),
f as (
  select *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words,
             100 * n_dup_lines > 40 * n_lines, 100 * n_upper > 60 * n_letters, 100 * n_letters < 50 * word_chars,
             word_chars > 15 * n_words, word_chars < 2 * n_words] as b from m)"""


@query("op10_quality_rules", MEASURED_SQL + r"""
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b[1] or b[2] as base_failed,
       not (b[1] or b[2] or b[3] or b[4] or b[5] or (b[6]::int + b[7]::int + b[8]::int > 1)) as kept,
       list_sum(list_transform(range(8), lambda i: b[i + 1]::bigint * (1 << i)::bigint))::bigint as failures
from f
""")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality ledger of ``documents`` and the current policy's verdict."""
    led = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "failures")


def _ablation_sql() -> str:
    policy = quality_rules.POLICIES[quality_rules.CURRENT]
    names = (*policy.fatal, *policy.soft)

    def rejects(cleared: str | None) -> str:
        fatal, soft = ([f"b[{quality_rules.RULES[n][0] + 1}]" for n in part if n != cleared] for part in (policy.fatal, policy.soft))
        many = " + ".join(f"{x}::int" for x in soft) or "0"
        return f"({' or '.join(fatal) or 'false'} or {many} > {policy.tolerance})"

    rows = " union all ".join(
        f"select '{n}' as rule, count(*) filter (where b[{quality_rules.RULES[n][0] + 1}]) as n_failed, "
        f"count(*) filter (where {rejects(None)} and not {rejects(n)}) as n_decided, {quality_rules.CURRENT}::int as policy_version from f"
        for n in names)
    return f"{MEASURED_SQL}\n{rows}"


@query("op10_ablation", _ablation_sql())
def op10_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy decides over ``documents``."""
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents")))


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing of all ``documents`` into 4096-token sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


@query("op3_secret_scan")
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of ``documents`` with the forest's verdict; the strings
    themselves stay out of the report."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), WORD_BPE, path_col="source")
    return found.select("doc_id", "word_no", "part", F.length("token").cast("long").alias("length"),
                        F.sha2("token", 256).alias("token_sha256"), F.round("probability", 6).alias("probability"),
                        "is_secret")


@query("op4_mtree_topk", """
with v as (
  select vec_id, row_number() over () as r, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.r, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.r <> c.r)
select query_id, (row_number() over w)::int as rank, vec_id, score from s
window w as (partition by r order by score desc, vec_id) qualify row_number() over w <= 5
""")
def op4_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products for every 50th of ``embeddings``, exact."""
    return metric_search.top_k(table(spark, sf_dir, "embeddings"))


@query("op5_warc", r"""
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as x from pages),
d as (
  select page_id, strlen(h)::bigint as payload_bytes, x, array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(x, (1 + 5 * (i // 4))::int, 5))::bigint >> (5 * (3 - i % 4))::bigint) & 31)::int + 1, 1)), '')
         as payload_digest, max(page_id) over (partition by x) as first from p)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from d
""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written to WARC archives and read back by the salvage reader."""
    back = warc.round_trip(table(spark, sf_dir, "pages")).filter("kind = 'record'")
    return back.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"))


@query("op6_chat_format", r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?INST\]|<SYS>>|</SYS>>|ROLE=|/ROLE\])'))
           + case role when 'user' then 13 when 'assistant' then 7 when 'system' then 15 else 14 + length(role) end
          )::bigint as formatted_chars
from t group by conv_id
""")
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and the conversation -7 formatted, encoded, masked
    and read back."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.read_back(chat_format.format_conversations(turns, BYTE_BPE))


def _license_sql() -> str:
    values = ", ".join(f"('{n}', '{t.replace(chr(39), chr(39) * 2)}')" for n, t in license_templates.TEMPLATES.items())
    return rf"""
with tpl(license_id, t) as (values {values}),
lines as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l, text from documents),
units as (
  select doc_id, i as unit, l[i + 1] as t from (select doc_id, l, unnest(range(len(l))) as i from lines)
  union all select doc_id, -1, text from lines where len(l) > 1),
words as (
  select 'u' as side, doc_id, unit, null as license_id, string_split(trim(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', ' ', 'g')),
         ' ') as w from units
  union all select 't', null, null, license_id, string_split(trim(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')
  from tpl),
g as (select side, doc_id, unit, license_id, len(w) - 1 as n, w[i] || ' ' || w[i + 1] as gram
      from (select *, unnest(range(1, len(w))) as i from words)),
c as (select side, doc_id, unit, license_id, n, gram, count(*) as c from g group by all),
both_sides as (
  select u.doc_id, u.unit, u.n, t.license_id, t.n as m, sum(least(u.c, t.c)) as k
  from c u join c t on u.side = 'u' and t.side = 't' and u.gram = t.gram group by all),
d as (select doc_id, unit, license_id, n, 2.0::double * k::double / (n + m) as dice from both_sides)
select doc_id, unit::bigint as unit, license_id, n::bigint as n_bigrams, round(dice, 6) as dice from d where dice >= 0.8
qualify row_number() over (partition by doc_id, unit order by dice desc, license_id) = 1
"""


@query("op7_license_scan", _license_sql())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and whole texts of ``documents`` that are a licence or its notice."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("dice", F.round("dice", 6))


@query("op7_license_passages")
def op7_license_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences and notices anywhere in ``documents``, whatever their lines."""
    return license_scan.passages(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))


@query("op8_html_extract")
def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages``."""
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` encoded by segment trees and decoded again."""
    enc = byte_bpe.encode(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return enc.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2(byte_bpe.decoded(F.col("ids"), BYTE_RANKS), 256).alias("decoded_sha256"))


@query("op11_benchmark_decontamination", r"""
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as g
       from (select item, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
dw as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as g
       from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)),
h as (select r, i, dw.n, item from dw join bw on dw.g = bw.g and dw.n = bw.n),
hit as (select r, count(distinct p) as n_hit from (select r, i + unnest(range(n)) as p from (select distinct r, i, n from h)) group by r),
its as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on hit.r = d.r left join its on its.r = d.r
""")
def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ``benchmark`` in all ``documents``."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level tokens of all ``documents`` against pieces."""
    return tokenizer_alignment.align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


@query("op13_source_divergence", r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r, regexp_extract_all(translate(
         coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
x as (select lang, source, r, unnest(w) as term from d),
kept as (select lang, term from x group by all having count(distinct r) >= 10),
grp as (select distinct lang, source from d),
v as (select lang, count(*)::hugeint as v from kept group by lang),
c as (select lang, source, term, count(*)::hugeint as n from x join kept using (lang, term) group by all),
tot as (select lang, source, sum(n)::hugeint as t from c group by all),
ltot as (select lang, sum(n)::hugeint as t from c group by all),
lc as (select lang, term, sum(n)::hugeint as n from c group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
             1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (coalesce(tot.t, 0) + 2 * v.v) as p
      from grp g join kept k on k.lang = g.lang join v on v.lang = g.lang
      left join tot on tot.lang = g.lang and tot.source = g.source
      left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select lc.lang, lc.term, 1 + 1000000000::hugeint * (lc.n + 2) // (ltot.t + 2 * v.v) as q
      from lc join ltot using (lang) join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
          from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, b.source as item from grp a join grp b on a.lang = b.lang and a.source <> b.source),
found as (
  select e.lang, e.source, 'pair' as part, e.item, coalesce(pairs.value, 0)::bigint as value
  from every e left join pairs using (lang, source, item)
  union all
  select p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // (p + q))::bigint from p join q using (lang, term)
  where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over w)::int as rank from found
window w as (partition by lang, source, part order by value desc, item)
qualify part = 'pair' or row_number() over w <= 10
""")
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language of ``documents`` differ in their words."""
    return divergence_audit.audit(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` over ``documents``."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
