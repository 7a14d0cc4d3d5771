"""The registered queries of the operators, one each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
#: ``reach``: the pairs of nodes of ``node`` that links ``link`` (a, b, both ways) connect.
_REACH = "reach as (select id as a, id as b from node union select r.a, l.b from reach r join link l on r.b = l.a)"

_JACCARD_SQL = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, {_SPACED}) as w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
both_in as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
link as (select a, b from both_in join n p on p.doc_id = a join n q on q.doc_id = b where 100 * k >= 75 * (p.n + q.n - k)),
node as (select doc_id as id from documents), {_REACH}
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(reach.b) as component_id,
  (select count(*) from link where link.a = d.doc_id) as n_links
from d left join n on n.doc_id = d.doc_id join reach on reach.a = d.doc_id group by d.doc_id"""

_SUBSTRING_SQL = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
g as (select p.doc_id, p.i, array_to_string(d.w[p.i:p.i + 34], ' ') as g from p join d on d.doc_id = p.doc_id),
twice as (select g from g group by 1 having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as i from g where g in (select g from twice)),
word as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
kept as (select word.doc_id, string_agg(word, ' ' order by word.i) as t, count(*) as n from word
         left join gone on gone.doc_id = word.doc_id and gone.i = word.i where gone.i is null group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(kept.n, 0) as bigint) as n_removed,
  sha256(coalesce(kept.t, '')) as kept_sha256 from d left join kept on kept.doc_id = d.doc_id"""

_COSINE_SQL = f"""
with recursive v as (select vec_id as id, list_transform(embedding, lambda x: x::double) as v from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select id, v, sqrt(list_dot_product(v, v)) as size from v),
link as (select x.id as a, y.id as b from u x join u y on x.id <> y.id and list_dot_product(x.v, y.v) / (x.size * y.size) >= 0.9),
node as (select vec_id as id from embeddings), {_REACH}
select reach.a as vec_id, (select count(*) from link where link.a = reach.a) as n_links, min(reach.b) as component_id,
  reach.a = min(reach.b) as kept from reach group by reach.a"""

_CONTAMINATION_SQL = f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from documents),
t as (select item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from benchmark),
win as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
        from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from t where len(w) > 0)),
size as (select distinct k from win),
p as (select doc_id, k, unnest(range(1, cast(len(w) - k + 2 as bigint))) as i from d, size where len(w) >= k),
found as (select p.doc_id, p.i, p.k, array_to_string(d.w[p.i:p.i + p.k - 1], ' ') as g from p join d on d.doc_id = p.doc_id),
hit as (select f.doc_id, f.i, f.k, win.item_id from found f join win on win.g = f.g and win.k = f.k),
words as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, cast(i + k as bigint))) as i from hit) group by 1),
items as (select doc_id, count(*) as n, string_agg(item_id, ',' order by item_id) as s from (select distinct doc_id, cast(item_id as varchar) as item_id from hit) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(words.n, 0) as n_hit, coalesce(items.n, 0) as n_items,
  sha256(coalesce(items.s, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from d left join words on words.doc_id = d.doc_id left join items on items.doc_id = d.doc_id"""

_WARC_SQL = """
with p as (select page_id, url, coalesce(html, '') as h from pages),
f as (select *, min(page_id) over (partition by h) as first, strlen(h) as n from p)
select page_id, cast(n as bigint) as payload_bytes, sha256(h) as payload_digest,
  case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first then first end as refers_to, url from f"""


def tokenizer_path() -> str:
    """The public byte-level vocabulary (its place is a parameter of the operators)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_token_files")
def op1(t: Tables) -> DataFrame:
    """Ids of every text with end id 2, written as PFOR files and read back."""
    from . import pfor
    return pfor.token_files(t.documents, tokenizer_path(), end_id=2)


@query("op6_token_counts")
def op6(t: Tables) -> DataFrame:
    """Tokens of every document, by a separator scan of flat files (end id 50256)."""
    from . import separators
    return separators.token_counts(t.documents, tokenizer_path(), end_id=50256)


@query("op2_toxicity")
def op2(t: Tables) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    from . import toxicity
    model = toxicity.fit(t.documents, t.labels)
    return toxicity.score(t.documents, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


@query("op3_jaccard_join", _JACCARD_SQL)
def op3(t: Tables) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of 0.75 over 5-word shingles, and each one's number of links."""
    from . import jaccard
    return jaccard.near_duplicates(t.documents).select("doc_id", "n_shingles", "component_id", "n_links")


@query("op4_substring_dedup", _SUBSTRING_SQL)
def op4(t: Tables) -> DataFrame:
    """Documents without the words of windows of 35 words that occur twice."""
    from . import substring
    return substring.deduplicate(t.documents).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op5_shards")
def op5(t: Tables) -> DataFrame:
    """Every document in one of 16 shards of nearly equal size."""
    from . import shards
    return shards.shard(t.documents, 16)


@query("op7_embedding_dedup", _COSINE_SQL)
def op7(t: Tables) -> DataFrame:
    """Groups of vectors with a cosine of 0.9 or more."""
    from . import hyperplane
    return hyperplane.near_duplicates(t.embeddings, 0.9)


@query("op8_contamination", _CONTAMINATION_SQL)
def op8(t: Tables) -> DataFrame:
    """Words of every document inside windows of the benchmark items."""
    from . import suffixes
    found = suffixes.contamination(t.documents, t.benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op9_warc", _WARC_SQL)
def op9(t: Tables) -> DataFrame:
    """Every page as a WARC record, archives read back by their index."""
    from . import warc
    return warc.archive(t.pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query("op10_bpe_roundtrip")
def op10(t: Tables) -> DataFrame:
    """Every text encoded by forced boundaries and decoded again, as digests."""
    from . import bpe
    return bpe.roundtrip_digest(t.documents, tokenizer_path())


@query("op11_mixture")
def op11(t: Tables) -> DataFrame:
    """Words that a mix of 150 % of all words takes of every document, sources weighed 5, 2, 1 in turn."""
    from . import mixing
    return mixing.mix(t.documents).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op12_whitening")
def op12(t: Tables) -> DataFrame:
    """Every usable vector on the first 32 principal axes, whitened."""
    from . import whitening
    return whitening.whiten(t.embeddings)


@query("op13_hard_negatives", sql="""
with v as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.rid as aid, a.vec_id as anchor_id, r.rid, r.vec_id, r.label = a.label as same,
    cast(list_dot_product(a.v, r.v) as bigint) as score
  from v a join v r on a.rid <> r.rid where a.vec_id % 50 = 0),
p as (
  select aid, anchor_id, rid as pid, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by aid order by score desc, vec_id) <= 5),
n as (
  select p.anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
    row_number() over (partition by p.aid, p.pid order by score desc, vec_id) as rank
  from p join s on s.aid = p.aid and not s.same
    and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 3""")
def op13(t: Tables) -> DataFrame:
    """The first three hard negatives of every anchor and positive, a seventh of the labels moved by one."""
    from . import negatives
    moved = t.embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(moved, F.col("vec_id") % 50 == 0)
