"""The queries over the driver's tables, one for each operator, with production parameters."""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, codes, embeddings, html, media, minhash, packing, passages, phrases, pii, toxicity, urls, warc
from .common import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


#: The rules of the URL query.
URL_RULES = (
    urls.Rule("block", "com", "/en/"),
    urls.Rule("allow", "example.com", "/en/7"),
    urls.Rule("allow", "net", "/de/"),
    urls.Rule("block", "example.net", "/de/8"),
    urls.Rule("block", "org", "/es/"),
)
#: Where the session names the secret key of surrogates.
PII_KEY = "spark.vialattice.surrogateKey"


def pii_key(spark: SparkSession) -> str:
    """The session's secret; where it has none, one is drawn and holds as long as the session.

    A corpus whose surrogates should agree from run to run needs its own.
    """
    if not spark.conf.get(PII_KEY, None):
        spark.conf.set(PII_KEY, secrets.token_hex(32))
    return spark.conf.get(PII_KEY)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), pii_key(spark))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.deduplicate(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_url_filter, op3_byte_bpe, op4_warc, op5_html_extraction,
        op6_minhash_near_dedup, op7_toxicity, op8_media_columns, op9_best_fit_packing, op10_pii_surrogates,
        op11_vector_codes, op12_collocations, op13_repeated_passages,
    )
}

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_COMPONENTS = """
reach(id, other) as (
  select id, id from nodes
  union
  select reach.id, links.b from reach join links on links.a = reach.other),
least as (select id, min(other) as component_id from reach group by id)
"""

_LLOYD_ROUND = """
near{k} as materialized (select vec_id, label, p, any_value(x) as x, (min(d * 256 + e) % 256)::int as e, (min(d * 256 + e) // 256)::bigint as d from (
  select v.vec_id, v.label, v.p, v.x, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint as d
  from parts v join book{k} b on v.p = b.p) group by vec_id, label, p)"""
_LLOYD_UPDATE = """,
mean{k} as (select p, e, list(floored order by j) as x from (
  select p, e, j, (s - ((s % n) + n) % n) // n as floored from (
    select p, e, j, sum(y)::hugeint as s, count(*)::hugeint as n from (select p, e, unnest(x) as y, unnest(range(len(x))) as j from near{k}) group by p, e, j)) group by p, e),
book{next} as materialized (select b.p, b.e, coalesce(m.x::bigint[], b.x) as x from book{k} b left join mean{k} m on m.p = b.p and m.e = b.e),"""
#: Six rounds of assignment and update, written out, and the last assignment.
_LLOYD_SQL = (
    """
with kept as (select vec_id, label, list_transform(embedding, lambda y: floor(4096 * y::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
parts as materialized (select vec_id, label, p, x[p * len(x) // 8 + 1:(p + 1) * len(x) // 8] as x from kept, range(8) r(p)),
book0 as materialized (select p, (row_number() over (partition by p order by vec_id) - 1)::int as e, x from parts qualify e < 16),"""
    + "".join(_LLOYD_ROUND.format(k=k) + _LLOYD_UPDATE.format(k=k, next=k + 1) for k in range(6))
    + _LLOYD_ROUND.format(k=6)
    + """,
coded as (select vec_id, label, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from near6 group by vec_id, label),
books as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from book6)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, books"""
)

#: For comparison, on any tables. Encoders, archives, extraction, scores, images, packing and
#: surrogates can't be written in SQL and are tested against plain versions instead.
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_near_dedup": f"""
with recursive nodes as (select vec_id as id, label, embedding::double[] as e from embeddings),
links as (
  select x.id as a, y.id as b from nodes x join nodes y on x.label = y.label and x.id <> y.id
  where list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.98::double),
{_COMPONENTS}
select least.id as vec_id, (select count(*) from links where a = least.id)::bigint as n_links, component_id, component_id = least.id as kept from least""",
    "op2_url_filter": f"""
with rules(verdict, host, path) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
rest as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, {_ASCII_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') as path from rest),
fits as (select p.page_id, max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) as best
  from parts p join rules r on starts_with(p.path, r.path) and ends_with('.' || p.host, '.' || r.host) group by p.page_id)
select p.page_id, p.host, p.path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from parts p left join fits using (page_id)""",
    "op6_minhash_near_dedup": rf"""
with recursive words as (select doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^ 	-
]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
nodes as (select doc_id as id, len(s)::bigint as n from sets),
items as (select doc_id as id, unnest(s) as g from sets),
shared as (select x.id as a, y.id as b, count(*) as k from items x join items y on x.g = y.g and x.id <> y.id group by all),
links as (select a, b from shared join nodes x on x.id = a join nodes y on y.id = b where 100 * k >= 75 * (x.n + y.n - k)),
{_COMPONENTS}
select nodes.id as doc_id, n as n_shingles, component_id, component_id = nodes.id as kept from nodes join least on least.id = nodes.id""",
    "op11_vector_codes": _LLOYD_SQL,
    "op12_collocations": rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_ASCII_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
runs as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (select lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as phrase from runs),
f as (select lang, phrase, len(string_split(phrase, ' ')) as size, count(*)::hugeint as f from grams group by all),
n as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
c as (select lang, phrase, size, f as a, string_split(phrase, ' ') as w from f where size > 1 and f >= 10),
cuts as (select lang, phrase, a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail from (select *, unnest(range(1, size)) as k from c)),
scored as (select x.lang, x.phrase, x.a, y.f as l, z.f as r, 1000000 * x.a * x.a // (y.f * z.f) as score
  from cuts x join f y on y.lang = x.lang and y.phrase = x.head join f z on z.lang = x.lang and z.phrase = x.tail
  qualify row_number() over (partition by x.lang, x.phrase order by score, x.k) = 1),
held as (select distinct s.lang, s.phrase from c s join c t on s.lang = t.lang and t.size > s.size and contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ') and 100 * t.a >= 50 * s.a)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from scored anti join held using (lang, phrase)) join n using (lang) where rank <= 2000""",
    "op13_repeated_passages": r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from docs)),
least as (select s, min(doc_id) as least from windows group by s),
covered as (select distinct doc_id, unnest(range(i, i + 13)) as p from windows join least using (s) where least < doc_id),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from docs),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t from words anti join covered using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from docs left join kept using (doc_id)""",
}
