"""One query for each operator, over the tables of a data folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fingerprint, html_extract, jaccard_join, packing, pii, topk, toxicity, warc
from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
VOCABULARY = "byte_bpe_50k.json"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivative_digests(table(spark, sf_dir, "pages"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    added = spark.createDataFrame(own, "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_conversations(conversations.unionByName(added))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_html": op2_html,
    "op3_jaccard": op3_jaccard,
    "op4_fingerprint": op4_fingerprint,
    "op5_bpe": op5_bpe,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_topk": op8_topk,
    "op9_packing": op9_packing,
    "op10_chat": op10_chat,
}

def _warc_sql() -> str:
    """Both records of every page, put together from macros in plain SQL."""
    urn = "'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32]"
    text = f"regexp_replace(html, '{warc.NO_TEXT}', ' ', 'g')"
    text = f"regexp_replace({text}, '{warc.WHITE_RUN}', ' ', 'g')"
    text = f"regexp_replace({text}, '{warc.LINE_TAG}', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[a-zA-Z/!?][^>]*>', '', 'g')"
    decoded = """array_to_string(list_transform(string_split(stripped, '&#'), lambda p, i:
        case when i = 1 then p
        when regexp_matches(p, '^[0-9]{1,7};') then
          chr(case when try_cast(regexp_extract(p, '^([0-9]+);', 1) as integer) between 1 and 1114111
            and try_cast(regexp_extract(p, '^([0-9]+);', 1) as integer) not between 55296 and 57343
            then try_cast(regexp_extract(p, '^([0-9]+);', 1) as integer) else 65533 end)
          || regexp_replace(p, '^[^;]*;', '')
        else '&#' || p end), '')"""
    for name, character in warc.NAMED:
        quoted = character.replace("'", "''")
        decoded = f"replace({decoded}, '{name}', '{quoted}')"
    tidy = f"regexp_replace({decoded}, '{warc.LINE_WHITE_RUN}', ' ', 'g')"
    tidy = f"regexp_replace({tidy}, ' \\n[ \\n]*|\\n[ \\n]+', chr(10), 'g')"
    tidy = f"trim({tidy}, ' ' || chr(10))"
    return f"""
      with source as (
        select coalesce(url, '') as uri, coalesce(html, '') as html,
          sha256('page|' || coalesce(page_id::varchar, '')) as h from pages),
      named as (select *, {urn} as source_id from source),
      ided as (select *,
          (select {urn} from (select sha256(source_id || '|metadata') as h)) as metadata_id,
          (select {urn} from (select sha256(source_id || '|conversion') as h)) as conversion_id,
          'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
            || 'Content-Length: ' || strlen(html) as http,
          {text} as stripped from named),
      texts as (select *, {tidy} as plain, 'sha256:' || sha256(html) as payload_digest,
          'sha256:' || sha256(http || chr(13) || chr(10) || chr(13) || chr(10) || html) as source_digest from ided),
      fields as (select *, replace(
          'source-record: ' || source_id || '~source-block-digest: ' || source_digest
          || '~source-payload-digest: ' || payload_digest || '~conversion-record: ' || conversion_id
          || '~http-status: 200~http-headers:~ ', '~', chr(13) || chr(10))
          || replace(http, chr(13) || chr(10), chr(13) || chr(10) || ' ') || chr(13) || chr(10) as meta from texts),
      records as (
        select 'metadata' as warc_type, metadata_id as record_id, source_id as refers_to, uri as target_uri,
          payload_digest, meta as block, 'application/warc-fields' as media from fields
        union all
        select 'conversion', conversion_id, source_id, uri, payload_digest, plain,
          'text/plain; charset=utf-8' from fields),
      digested as (select *, 'sha256:' || sha256(block) as block_digest, strlen(block) as content_length from records)
      select warc_type, record_id, refers_to, target_uri, block_digest, content_length,
        sha256(replace('WARC/1.1~WARC-Type: ' || warc_type || '~WARC-Record-ID: <' || record_id
          || '>~WARC-Refers-To: <' || refers_to || '>~WARC-Refers-To-Target-URI: ', '~', chr(13) || chr(10)) || target_uri
          || replace('~WARC-Refers-To-Date: 2024-01-01T00:00:00Z~WARC-Target-URI: ', '~', chr(13) || chr(10)) || target_uri
          || replace('~WARC-Date: 2024-01-01T00:00:00Z~WARC-Source-Payload-Digest: ' || payload_digest
          || '~WARC-Block-Digest: ' || block_digest || '~Content-Type: ' || media
          || '~Content-Length: ' || content_length || '~~', '~', chr(13) || chr(10))) as header_sha256
      from digested
    """


ORACLE_SQL = {
    "op1_warc": _warc_sql(),
    "op3_jaccard": r"""
        with recursive words as (
          select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') as w from documents),
        grams as (
          select distinct doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g
          from words where len(w) > 0),
        sets as (select doc_id, count(*) as n from grams group by doc_id),
        links as (
          select a.doc_id as x, b.doc_id as y
          from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id
          join sets sa on sa.doc_id = a.doc_id join sets sb on sb.doc_id = b.doc_id
          group by a.doc_id, b.doc_id, sa.n, sb.n
          having count(*) >= 0.8 * (sa.n + sb.n - count(*)) - 1e-9),
        reach as (
          select x, y from links
          union
          select r.x, l.y from reach r join links l on r.y = l.x),
        least as (select x, min(y) as y from reach group by x),
        counts as (select x, count(*) as n from links group by x)
        select d.doc_id, least(d.doc_id, coalesce(l.y, d.doc_id)) as class_id, coalesce(c.n, 0) as n_links
        from documents d left join least l on l.x = d.doc_id left join counts c on c.x = d.doc_id
    """,
    "op8_topk": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
          from embeddings
          where embedding is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
          select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
          from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
        ranked as (
          select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
        select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
    """,
    "op10_chat": r"""
        with rows_ as (
          select conv_id, turn, role, text from conversations
          union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
          union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        said as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
                 regexp_replace(coalesce(role, ''), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') as role_out,
                 regexp_replace(coalesce(text, ''), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') as text_out
          from rows_)
        select conv_id, count(*) as n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
          cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
          sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
          cast(3 + sum(7 + length(role_out) + 8 + length(text_out) + 4) as bigint) as formatted_chars
        from said group by conv_id
    """,
}
