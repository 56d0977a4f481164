"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, near_dups, packing, quality, repeats, store, token_counts, toxicity, url_rules, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures of every document and the cascade's verdict."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ranked = quality.estimate(docs, quality.default_rules())
    judged = quality.cascade(docs, quality.default_rules(), prepare=quality.measure, ranked=ranked)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality.base_failed().alias("base_failed"), (~quality.base_failed() & F.col("kept")).alias("kept"))


OP1_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents
), g as (
  select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram
  from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)
), r as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g) where n > 1
), c as (
  select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from r) group by doc_id
), m as (
  select w.doc_id, text, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join c using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (
    100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 30 * n_lines or word_chars < 2 * n_words or word_chars > 20 * n_words
    or 100 * (length(text) - length(replace(text, '!', ''))) > 30 * n_words
    or 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 40 * word_chars) as kept
from m
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, read back and assembled into captures."""
    path = store.new_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    captures = store.materialise(warc.assemble(warc.read_archives(spark, path)), "captures")
    page = F.col("metadata.page").cast("long")
    ids = captures.select(F.col("capture_id").alias("refers"), page.alias("refers_to"))
    rows = captures.select(page.alias("page_id"), "response.payload_bytes", "response.payload_digest", "response.record_type", F.col("response.refers_to").alias("refers"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return rows.join(ids, "refers", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), f as (
  select payload_digest, max(page_id) as first_id from p where payload_bytes >= 1000 group by 1
)
select page_id, payload_bytes, payload_digest, case when first_id is null or first_id = page_id then 'response' else 'revisit' end as record_type,
  case when first_id <> page_id then first_id end as refers_to
from p left join f using (payload_digest)
"""

# The rules that op3 judges by.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address judged by the rules and by its aliases."""
    return url_rules.judge(_table(spark, sf_dir, "pages"), URL_RULES)


# Holds for tables whose pages have no redirect or canonical link, as the given ones; aliases are tested on fixtures.
OP3_SQL = r"""
with h as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages
), r(rule, rule_host, rule_path, rule_verdict) as (
  values ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'block'),
    ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), b as (
  select page_id, arg_max(rule, length(rule)) as rule, arg_max(rule_verdict, length(rule)) as rule_verdict
  from h join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id
)
select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict from h left join b using (page_id)
"""


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document through the digest cache."""
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents, by shingles of four words."""
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, similarity=80)


OP4_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), sh as (
  select distinct doc_id, array_to_string(words[p : p + 3], ' ') as gram
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as p from w where len(words) > 0)
), sizes as (
  select doc_id, count(*) as n from sh group by 1
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from sh a join sh b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)
), edges as (
  select a as u, b as v from links union all select b, a from links
), reach(doc_id, other) as (
  select doc_id, doc_id from w union select doc_id, v from reach join edges on u = other
)
select doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(other) as component_id, min(other) = doc_id as kept
from reach left join sizes using (doc_id) group by doc_id
"""


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 20 words or more that start earlier too."""
    docs = _table(spark, sf_dir, "documents")
    return repeats.kept_words(docs, repeats.repeats(docs, window=20, each_text=True))


OP7_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), win as (
  select doc_id, s, array_to_string(words[s + 1 : s + 20], ' ') as win from (select doc_id, words, unnest(range(0, len(words) - 19)) as s from w)
), rep as (
  select doc_id, s from (select doc_id, s, row_number() over (partition by win order by doc_id, s) as nth from win) where nth > 1
), gone as (
  select distinct doc_id, p from (select doc_id, unnest(range(s, s + 20)) as p from rep)
), kept as (
  select doc_id, string_agg(word, ' ' order by p) as text
  from (select doc_id, p, words[p + 1] as word from (select doc_id, words, unnest(range(0, len(words))) as p from w)) anti join gone using (doc_id, p) group by doc_id
)
select w.doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from w left join (select doc_id, count(*) as n from gone group by 1) using (doc_id) left join kept using (doc_id)
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP5_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
), i as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark
), iw as (
  select distinct item_id, k, array_to_string(words[p : p + k - 1], ' ') as win
  from (select item_id, words, least(10, len(words)) as k, unnest(range(1, len(words) - least(10, len(words)) + 2)) as p from i where len(words) > 0)
), dw as (
  select doc_id, p, k, array_to_string(words[p : p + k - 1], ' ') as win
  from (select doc_id, words, k, unnest(range(1, len(words) - k + 2)) as p from w, (select distinct k from iw))
), hit as (
  select doc_id, p, dw.k, item_id from dw join iw using (k, win)
), words_hit as (
  select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(p, p + k)) as x from (select distinct doc_id, p, k from hit)) group by 1
), items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, item_id::varchar as item from hit) group by 1
)
select w.doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join words_hit using (doc_id) left join items using (doc_id)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens at most."""
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.drop("ids")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# Exact containment of every template in every window; bands only choose what is compared, with a chance of missing that is given in licenses.
OP9_SQL = """
with t(template, license, text) as (values __TEMPLATES__),
tw as (select template, license, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '') as w from t),
tk as (select template, license, w, least(len(w), 5) as k from tw),
tg as (select template, license, k, list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as grams from tk),
tn as (select *, len(grams) as n, pow(2, floor(log2(len(grams))))::bigint as m from tg),
te as (select template, k, unnest(grams) as gram from tn),
dw as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '') as w from documents),
dg as (select doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') as gram from (select doc_id, w, k, unnest(range(0, len(w) - k + 1)) as p from dw, (select distinct k from tn))),
hit as (select doc_id, template, license, n, gram, p // m - back as j from dg join te using (k, gram) join tn using (template, k), (select unnest([0, 1, 2]) as back)),
part as (select doc_id, template, license, j, count(distinct gram) * 100.0::double / n as part from hit where j >= 0 group by doc_id, template, license, j, n),
best as (select doc_id, license, template, max(part) as part from part where part >= 80 group by all)
select doc_id, license, max(part) as containment, count(*) as n_templates from best group by doc_id, license
""".replace("__TEMPLATES__", ", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES)))

QUERIES = {"op1_quality": op1_quality, "op2_warc": op2_warc, "op3_urls": op3_urls, "op4_near_dups": op4_near_dups, "op5_decontaminate": op5_decontaminate, "op6_toxicity": op6_toxicity, "op7_repeats": op7_repeats, "op8_packing": op8_packing, "op9_licenses": op9_licenses, "op10_tokens": op10_tokens}
ORACLES = {"op1_quality": OP1_SQL, "op2_warc": OP2_SQL, "op3_urls": OP3_SQL, "op4_near_dups": OP4_SQL, "op5_decontaminate": OP5_SQL, "op7_repeats": OP7_SQL, "op9_licenses": OP9_SQL}
