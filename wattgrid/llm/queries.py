"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wattgrid.llm.bpe import round_trip
from wattgrid.llm.conversation_repair import repair_digests
from wattgrid.llm.exact_dedup import exact_duplicates
from wattgrid.llm.html_text import extract_text
from wattgrid.llm.line_dedup import line_digests
from wattgrid.llm.near_dups import near_duplicates
from wattgrid.llm.packing import pack_documents
from wattgrid.llm.personal_data import personal_digests
from wattgrid.llm.quality import score_documents, train_on
from wattgrid.llm.ranked_search import ranked_search
from wattgrid.llm.substring_dedup import substring_digests
from wattgrid.llm.url_filter import judge_urls
from wattgrid.llm.vector_dedup import link_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, train_on(docs, _table(spark, sf_dir, "labels")))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digests(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_html_text, op3_exact_dedup, op4_url_filter, op5_ngram_jaccard, op6_vector_dedup, op7_packing, op8_bpe_round_trip, op9_line_dedup, op10_substring_dedup,
        op11_ranked_search, op12_personal_data, op13_conversation_repair,
    )
}

ORACLES = {
    "op3_exact_dedup": """
        with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
        select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
               doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
        from d""",
    "op4_url_filter": r"""
        with recursive p as (
            select page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^#]*)', 1) as tail,
                   regexp_extract(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) as scheme
            from pages),
        rules(own, rh, rp) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        n as (select *, case when host <> '' then host || case when tail = '' then '/' else tail end end as node from p),
        fits as (select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(own, length(rh || rp)) as own
                 from n join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id),
        h as (select node as a, scheme, host, path, regexp_replace(html, '(?is)<!--.*?(-->|$)|<script[\s/>].*?(</script[\s/>]|$)|<style[\s/>].*?(</style[\s/>]|$)|<textarea[\s/>].*?(</textarea[\s/>]|$)|<title[\s/>].*?(</title[\s/>]|$)|<xmp[\s/>].*?(</xmp[\s/>]|$)|<iframe[\s/>].*?(</iframe[\s/>]|$)|<noembed[\s/>].*?(</noembed[\s/>]|$)|<noframes[\s/>].*?(</noframes[\s/>]|$)', '', 'g') as html from n where node is not null),
        raw as (select *, row_number() over () as tag_no from (select a, scheme, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)(?:[\s/](?:[^>"''<]|"[^"<]*"|''[^''<]*'')*)?>')) as tag from h)),
        attr as (select tag_no, lower(regexp_extract(x, '^[^\s=]+')) as name, regexp_replace(trim(regexp_replace(x, '^[^\s=]+\s*=?', ''), chr(9) || chr(10) || chr(12) || chr(13) || ' '), '^(["''])((?s:.*))["'']$', '\2') as value, k
                 from (select tag_no, unnest(regexp_extract_all(tag[6:], '[^\s"''>/=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"'']+))?')) as x, generate_subscripts(regexp_extract_all(tag[6:], '[^\s"''>/=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"'']+))?'), 1) as k from raw)),
        given as (select tag_no, arg_min(value, k) filter (name = 'rel') as rel, arg_min(value, k) filter (name = 'href') as href, arg_min(value, k) filter (name = 'http-equiv') as equiv, arg_min(value, k) filter (name = 'content') as content from attr group by 1),
        tags as (
            select a, scheme, host, path, trim(t, chr(9) || chr(10) || chr(12) || chr(13) || ' ') as t from (
                select a, scheme, host, path, href as t from raw join given using (tag_no) where lower(tag[2:5]) = 'link' and list_contains(regexp_split_to_array(lower(rel), '\s+'), 'canonical')
                union all
                select a, scheme, host, path, regexp_replace(regexp_replace(content, '(?i)^\s*[0-9.]*\s*[;,]?\s*(url\s*=\s*)?', ''), '^(?:"([^"]*)"?|''([^'']*)''?).*$', '\1\2')
                from raw join given using (tag_no) where lower(tag[2:5]) = 'meta' and lower(trim(equiv)) = 'refresh')),
        marks as (select *, regexp_extract_all(t, '(?s)&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|lt|gt|quot|apos);|[^&]+|&') as parts from tags where t <> ''),
        codes as (select *, list_transform(parts, lambda x: case when starts_with(lower(x), '&#x') and ends_with(x, ';') then try_cast('0x' || x[4:-2] as bigint) when starts_with(x, '&#') and ends_with(x, ';') then try_cast(x[3:-2] as bigint) end) as nums from marks),
        d as (select a, scheme, host, path, array_to_string(list_transform(parts, lambda x, i: case
                when nums[i] between 1 and 55295 or nums[i] between 57344 and 1114111 then chr(nums[i]::int) when x = '&amp;' then '&' when x = '&lt;' then '<' when x = '&gt;' then '>'
                when x = '&quot;' then '"' when x = '&apos;' then chr(39) else x end), '') as t from codes),
        g as (select *, regexp_extract(t, '(?s)^[^?#]*', 0) as own, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) as rest from d),
        abs as (select *, case when starts_with(own, '/') then own when own = '' then null else regexp_replace(case when path = '' then '/' else path end, '[^/]*$', '') || own end as whole from g),
        steps as (select *, string_split(whole, '/') as s from abs),
        clean as (select *, '/' || ltrim(list_reduce(list_concat([''], s[2:]), lambda acc, x: case when x = '..' then regexp_replace(acc, '/[^/]*$', '') when x = '.' then acc else acc || '/' || x end), '/')
                         || case when s[-1] in ('.', '..') and len(s) > 2 then '/' else '' end as dotless from steps),
        f as (select a, case
                when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') or t = '' or starts_with(t, '#') or scheme = '' then null
                when starts_with(t, '//') then scheme || ':' || t when starts_with(t, '?') then scheme || '://' || host || case when path = '' then '/' else path end || t
                else scheme || '://' || host || regexp_replace(dotless, '//+$', '/') || rest end as u from clean),
        e as (select a, lower(regexp_extract(u, '^.*?://([^/?#]*)', 1)) || case when regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) = '' then '/' else regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) end as b
              from f where u is not null and regexp_extract(u, '^.*?://([^/?#]*)', 1) <> ''),
        reach(x, y) as (
            select node, node from n join fits using (page_id) where own = 'block' and node is not null
            union
            select r.x, s.b from reach r join (select a, b from e union select b, a from e) s on r.y = s.a)
        select n.page_id, host, path, rule, coalesce(own, case when node in (select y from reach) then 'block' else 'allow' end) as verdict
        from n left join fits using (page_id)""",
    "op11_ranked_search": r"""
        with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
        total as (select count(*) as n_docs, sum(len(terms))::bigint as n_terms from d where len(terms) > 0),
        tf as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(terms) as n, unnest(terms) as term from d) group by all),
        df as (select term, count(*) as df from tf group by term),
        asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        scores as (
            select item_id, r, doc_id, sum(floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::bigint as score
            from asked join tf using (term) join df using (term), total group by item_id, r, doc_id),
        ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scores where score > 0)
        select item_id, rank, doc_id, score from ranked where rank <= 10""",
}
