"""Registered queries of the training-data operators: each applies its operator
to its whole table and returns the columns of the operator's contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendermatch.llm import (bpe, collocations, embedding_dedup, exact_dedup, html_extract, lexical_search, line_dedup, lm_score, minhash_dedup,
                             mixing, quality_mil, url_filter, word_bpe)
from tendermatch.llm.common import read, remainder

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WORD_VOCABULARY = "word_bpe_49k.json"


def rank_file(name: str = VOCABULARY) -> bytes:
    """A vocabulary's bytes, read once on the driver."""
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality_mil.Model | None:
    """Fitted on labelled rows that are not held out (crc32 of the id modulo 3 is not 1)."""
    labels = read(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1).select("doc_id", "quality")
    labels = labels.dropna().dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(quality_mil.TRAIN_DOCS)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_mil.train(docs.join(F.broadcast(labels), "doc_id"))      # at most TRAIN_DOCS rows


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 3) == 1).alias("held_out"))
    return quality_mil.score(docs, quality_model(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(read(spark, sf_dir, "documents"))
    return drawn.select("own.doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from rows whose crc32 of the id modulo 10 is not 0."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_score.score(docs, remainder("doc_id", 10) != 0, rank_file(), public_tokenizers.PATTERN)
    return scored.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classes(read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN, keep_ids=False)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encode_documents(read(spark, sf_dir, "documents"), rank_file(WORD_VOCABULARY), keep_ids=False)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_quality_mil, op3_line_dedup, op4_url_filter, op5_mixing, op6_lm_score,
                                   op7_pivot_index, op8_bag_minhash, op9_exact_dedup, op10_byte_bpe, op11_collocations, op12_word_bpe,
                                   op13_lexical_search)}

#: White space of the contracts, for string literals of DuckDB.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _mixing_sql() -> str:
    """Budgets level by level, then the seeded prefix of every leaf."""
    def level(depth: int) -> str:
        names = mixing.LEVELS[:depth + 1]
        parent, by, name = names[:-1], ", ".join(names), names[-1]
        known = {k: v for k, v in mixing.WEIGHTS[name].items() if k != "*"}
        cases = " ".join(f"when {name} = '{k}' then {v}" for k, v in known.items())
        rest = mixing.WEIGHTS[name]["*"]
        weight = f"(case {cases} else {rest} end)" if cases else str(rest)
        part = f"partition by {', '.join(parent)}" if parent else ""
        full = f"partition by {', '.join([*parent, 'is_full'])}"
        given = f"join share{depth - 1} using ({', '.join(parent)})" if parent else (
            f"cross join (select least(sum(cap), sum(tokens) * {mixing.SHARE[0]} // {mixing.SHARE[1]}) as given from leaves)")
        return f"""
node{depth} as (
  select n.*, given from (select {by}, sum(cap)::hugeint as cap, {weight}::hugeint as weight from leaves group by {by}) n {given}),
laid{depth} as (
  select *, given - (sum(cap) over upto - cap) as remains, sum(weight) over (upto rows between current row and unbounded following) as others
  from node{depth} window upto as ({part} order by cap::double / weight::double, {name})),
fill{depth} as (
  select *, min((remains * weight >= cap * others)::int) over ({part} order by cap::double / weight::double, {name}) = 1 as is_full
  from laid{depth}),
pool{depth} as (
  select *, max(remains) over ({full}) as pool, (max(remains) over ({full}) * weight) // sum(weight) over ({full}) as part,
         row_number() over ({full} order by {name}) as nth from fill{depth}),
share{depth} as (
  select {by}, case when is_full then cap else least(cap, part + (nth <= pool - sum(part) over ({full}))::int) end as given
  from pool{depth})"""
    curated = ", ".join(f"'{s}'" for s in mixing.CURATED)
    by = ", ".join(mixing.LEVELS)
    return f"""
with own as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         case when coalesce(source, '') = 'src0' then 'bulk' when source in ({curated}) then 'curated' else 'other' end as domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_tokens from documents),
leaves as (
  select {by}, sum(n_tokens) as tokens, sum(n_tokens) * {mixing.EPOCHS} as cap from own group by {by}),
{",".join(level(k) for k in range(3)).strip()},
plan as (
  select {by}, given // greatest(tokens, 1) as whole, given - tokens * (given // greatest(tokens, 1)) as rest
  from leaves join share2 using ({by})),
keyed as (
  select own.*, whole, rest, md5('{mixing.SEED}:' || (whole + 1)::bigint || ':' || coalesce(doc_id::varchar, '')) as key
  from own join plan using ({by})),
ahead as (
  select *, coalesce(sum(n_tokens) over (partition by {by} order by key range between unbounded preceding and current row)
                     - sum(n_tokens) over (partition by {by}, key), 0) as before from keyed),
times as (
  select *, whole + (rest > 0 and before < rest)::int as n from ahead)
select doc_id, domain, lang, source, n_tokens, u.epoch::int as epoch
from times, lateral (select unnest(range(1, n::bigint + 1)) as epoch) u"""


#: A-Z to a-z, for DuckDB.
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES = {
    "op3_line_dedup": f"""
with lines as (
  select doc_id, u.line, u.pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents) d,
       lateral (select unnest(d.parts) as line, generate_subscripts(d.parts, 1) as pos) u),
keyed as (
  select doc_id, pos, line, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
judged as (
  select doc_id, pos, line, length(key) >= 10 and doc_id > min(doc_id) over (partition by key) as dropped from keyed)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id""",
    "op4_url_filter": """
with own as (
  select page_id, url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from own),
rules(r_host, r_path, r_verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                            ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best as (
  select page_id, arg_max(r_host || r_path, length(r_host || r_path)) as rule,
         arg_max(r_verdict, length(r_host || r_path)) as verdict
  from parts join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join best using (page_id)""",
    "op5_mixing": _mixing_sql(),
    "op9_exact_dedup": """
with own as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept,
       sha256(norm) as text_sha256
from own window w as (partition by norm)""",
    "op11_collocations": f"""
with pieces as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(p, '[^\\x20\\x09]+') as ws
  from (select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\\x0A-\\x0D]')) as p from documents)),
f1 as (
  select lang, w, count(*) as f from (select lang, unnest(ws) as w from pieces) group by all),
f2 as (
  select lang, g.a as w1, g.b as w2, count(*) as f
  from (select lang, unnest(list_transform(range(1, len(ws)), lambda i: {{'a': ws[i], 'b': ws[i + 1]}})) as g from pieces) group by all),
f3 as (
  select lang, g.a as w1, g.b as w2, g.c as w3, count(*) as f
  from (select lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'a': ws[i], 'b': ws[i + 1], 'c': ws[i + 2]}})) as g from pieces)
  group by all),
total as (select lang, sum(f)::bigint as n from f1 group by lang),
cuts as (
  select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 as phrase, f3.f as a, 1 as k, x.f as l, y.f as r
  from f3 join f1 x on x.lang = f3.lang and x.w = f3.w1 join f2 y on y.lang = f3.lang and y.w1 = f3.w2 and y.w2 = f3.w3
  where f3.f >= 10
  union all
  select f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, x.f, y.f
  from f3 join f2 x on x.lang = f3.lang and x.w1 = f3.w1 and x.w2 = f3.w2 join f1 y on y.lang = f3.lang and y.w = f3.w3
  where f3.f >= 10
  union all
  select f2.lang, f2.w1 || ' ' || f2.w2, f2.f, 1, x.f, y.f
  from f2 join f1 x on x.lang = f2.lang and x.w = f2.w1 join f1 y on y.lang = f2.lang and y.w = f2.w2
  where f2.f >= 10
    and not exists (select 1 from f3 where f3.lang = f2.lang and f3.w1 = f2.w1 and f3.w2 = f2.w2 and f3.f >= 10 and 100 * f3.f >= 50 * f2.f)
    and not exists (select 1 from f3 where f3.lang = f2.lang and f3.w2 = f2.w1 and f3.w3 = f2.w2 and f3.f >= 10 and 100 * f3.f >= 50 * f2.f)),
scored as (
  select *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint as score from cuts),
lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from lowest join total using (lang) qualify rank <= 2000""",
    "op13_lexical_search": f"""
with own as (
  select doc_id, t.term from (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
                                             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from documents) t),
items as (
  select distinct item_id, t.term from (
    select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
                                              '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark) t),
sizes as (select doc_id, count(*) as n from own group by doc_id),
all_docs as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sizes),
tfs as (select doc_id, term, count(*) as tf from own group by all),
weights as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tfs, all_docs group by term, n_docs),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::bigint as score
  from items join tfs using (term) join weights using (term) join sizes using (doc_id), all_docs group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0 qualify rank <= 50""",
}
