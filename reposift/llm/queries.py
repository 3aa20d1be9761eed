"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposift.llm.common import cut, table
from reposift.llm.exact_dedup import exact_duplicates
from reposift.llm.html_extract import extract_articles
from reposift.llm.language import fit_language_model, held_out, with_language
from reposift.llm.lexical_search import rank_documents
from reposift.llm.near_dedup import near_duplicates
from reposift.llm.packing import pack
from reposift.llm.periodic_runs import periodic_runs, planted
from reposift.llm.sharding import kd_shards
from reposift.llm.suffix_dedup import repeated_passages
from reposift.llm.toxicity import fit_toxicity, with_toxicity
from reposift.llm.word_bpe import with_tokens
from reposift.llm.top_k import exact_top_k, integer_vectors
from reposift.llm.url_filter import Rule, canonical, host_and_path, judge_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op8_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("ties", "row")


ORACLES["op8_exact_dedup"] = """
select doc_id,
       max(doc_id) over same as keep_id,
       count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""


@query
def op5_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op1_packing(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op6_suffix_array_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents")).drop("row")


@query
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", held_out(F.col("doc_id"), 3, 1).alias("held_out")
    )
    model = fit_language_model(docs.filter("not held_out and doc_id is not null"))
    return with_language(docs, model).drop("text", "lang")


@query
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out")
    )
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 5, 0))
    model = fit_toxicity(docs.filter("not held_out"), labels.select("doc_id", "toxic"))
    return with_toxicity(docs, model).drop("text")


@query
def op7_bpe(spark, sf_dir):
    docs = with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


@query
def op2_url_filters(spark, sf_dir):
    """The list: canonical URLs that some page was reached at with tracking parameters."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    tracked = pages.filter(F.col("url").contains("utm_source="))
    listed = tracked.select(canonical(*host_and_path(F.col("url"))).alias("url"))
    listed = cut(listed.filter("url is not null").distinct(), "listed")
    return judge_urls(pages, listed, RULES)


ORACLES["op2_url_filters"] = r"""
with split as (
    select page_id, url,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
    from pages
), named as (
    select *, case when host <> '' then regexp_replace(host, '^(www|m)\.', '')
                  || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '') end as canonical
    from split
), rules(verdict, rule_host, rule_path) as (
    values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
           ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fitting as (
    select named.*, rules.verdict, rule_host || rule_path as rule,
           row_number() over (partition by page_id, url
                              order by length(rule_host || rule_path) desc nulls last) as place
    from named left join rules
      on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
), listed as (
    select distinct canonical from named where url like '%utm\_source=%' escape '\'
)
select page_id, host, path, rule,
       coalesce(verdict, case when canonical in (select canonical from listed where canonical is not null)
                              then 'block' else 'allow' end) as verdict
from fitting where place = 1
"""


@query
def op10_exact_top_k(spark, sf_dir):
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLES["op10_exact_top_k"] = """
with v as (
    select vec_id, list_transform(embedding, lambda c: floor(256 * cast(c as double))) as x
    from embeddings
    where embedding is not null and vec_id is not null
      and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
), scored as (
    select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.x, v.x) as bigint) as score
    from v q join v on q.vec_id <> v.vec_id
    where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over best as integer) as rank, vec_id, score
from scored
window best as (partition by query_id order by score desc, vec_id)
qualify rank <= 5
"""


@query
def op3_sharding(spark, sf_dir):
    return kd_shards(table(spark, sf_dir, "documents"), shards=8)


@query
def op11_lexical_search(spark, sf_dir):
    """The 50 best of all documents for every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_lexical_search"] = r"""
with docs as (
    select row_number() over () as row, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
), sizes as (
    select count(*) as n_docs, sum(len(terms)) as n_terms from docs where len(terms) > 0
), asked as (
    select distinct item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark where item_id is not null
), words as (
    select row, doc_id, len(terms) as n, unnest(terms) as term from docs
), held as (
    select row, doc_id, n, term, count(*) as tf from words
    where term in (select term from asked) group by all
), weights as (
    select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) as bigint) as w
    from held, sizes group by term
), scored as (
    select item_id, row, doc_id,
           cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) as bigint)
             as score
    from asked join held using (term) join weights using (term), sizes
    where doc_id is not null
    group by all
)
select item_id, cast(row_number() over best as integer) as rank, doc_id, score
from scored where score > 0
window best as (partition by item_id order by score desc, doc_id)
qualify rank <= 50
"""


@query
def op12_html_extraction(spark, sf_dir):
    """The article of every page, by the wrapper of its host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_articles(pages)


@query
def op13_periodic_runs(spark, sf_dir):
    """The runs of every document, a tenth of them with a repeating end (see ``planted``)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs).drop("text")
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    start, length, period = -longest["s"], longest["n"], -longest["p"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
