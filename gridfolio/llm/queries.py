"""Registered queries of this subpackage, and the SQL texts that check those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gridfolio.llm.common import let_tasks_import, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        let_tasks_import(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to ZIP-packaged archives and read back by ranges."""
    from gridfolio.llm.zip_warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


CHECKS["op1_zip_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
q as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest from p),
r as (select *, max(page_id) over (partition by payload_digest) as last from q)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id < last then last end as refers_to
from r
"""


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likeness to both neighbours."""
    from gridfolio.llm.simhash import fingerprints_with_edits

    return fingerprints_with_edits(table(spark, sf_dir, "documents"))


@query
def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    from gridfolio.llm.dart_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).selectExpr("id as doc_id", "class_id", "id = class_id as kept")


CHECKS["op4_dart_minhash"] = """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as w from documents
), runs as (
  select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0
), shingles as (
  select doc_id, hash(array_to_string(w[i:i + 4], ' ')) as s, count(*) as n from runs group by all
), sizes as (
  select doc_id, sum(n) as total from shingles group by all
), common as (
  select a.doc_id as a, b.doc_id as b, sum(least(a.n, b.n)) as shared
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all
), links as (
  select a, b from common join sizes x on a = x.doc_id join sizes y on b = y.doc_id
  where shared >= 0.8 * (x.total + y.total - shared)
), sides as (
  select a, b from links union all select b, a from links
), reached(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, s.b from reached r join sides s on r.other = s.a
)
select doc_id, min(other) as class_id, doc_id = min(other) as kept from reached group by doc_id
"""


@query
def op10_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every embedding to others of its label, and its component."""
    from gridfolio.llm.pstable import linked_vectors

    return linked_vectors(table(spark, sf_dir, "embeddings"))


CHECKS["op10_pstable"] = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), u as (
  select vec_id, label, e, sqrt(list_inner_product(e, e)) as norm from v where list_inner_product(e, e) > 0
), links as (
  select x.vec_id as a, y.vec_id as b from u x join u y on x.label = y.label and x.vec_id <> y.vec_id
  where list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.93
), reached(vec_id, other) as (
  select vec_id, vec_id from embeddings union select r.vec_id, l.b from reached r join links l on r.other = l.a
), components as (select vec_id, min(other) as component_id from reached group by vec_id),
counts as (select a, count(*) as n from links group by a)
select c.vec_id, coalesce(n, 0) as n_links, component_id, c.vec_id = component_id as kept
from components c left join counts on c.vec_id = counts.a
"""


@query
def op5_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    from gridfolio.llm.toxic_crf import toxic_documents

    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms for the private values in it, and where they are."""
    from gridfolio.llm.pseudonyms import pseudonyms

    return table(spark, sf_dir, "documents").select("doc_id", pseudonyms(F.col("text")).alias("p")).select("doc_id", "p.text", "p.found")


@query
def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and rate of every document for the production targets."""
    from gridfolio.llm.soft_mixing import mixing_rates

    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    from gridfolio.llm.viterbi import encoded

    return encoded(table(spark, sf_dir, "documents"))


@query
def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and check sum of every document's ids in ORC files."""
    from gridfolio.llm.token_orc import tokens_through_orc

    return tokens_through_orc(table(spark, sf_dir, "documents"))


@query
def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and length of every document in flat token files."""
    from gridfolio.llm.separator_scan import counted_documents

    return counted_documents(table(spark, sf_dir, "documents"))


@query
def op11_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding by inner product."""
    from gridfolio.llm.block_search import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"))


CHECKS["op11_block_search"] = """
with v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""


@query
def op12_merkle_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion proofs of all documents in a manifest of a tree per language, and which of the tampered ones they expose."""
    from gridfolio.llm.merkle import document_proofs

    return document_proofs(table(spark, sf_dir, "documents"))


def _field(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || cast({value} as varchar), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC = """xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)))"""
_RUNS = "list_transform(range(0, len(l), 8), lambda i: sha256(array_to_string(l[i + 1:i + 8], '')))"
CHECKS["op12_merkle_intervals"] = f"""
with recursive leaves as (
  select doc_id, lang, {_leaf('text')} as leaf, case when {_CRC} % 3 = 0 then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as other from documents
), ranked as (select *, row_number() over (partition by lang order by doc_id) - 1 as r from leaves),
rows_of(lang, level, l) as (
  select lang, 0, list(leaf order by r) from ranked group by lang
  union all select lang, level + 1, {_RUNS} from rows_of where len(l) > 1
), subroots as (
  select lang, l[1] as subroot, row_number() over (order by lang collate "binary" nulls first) - 1 as r from rows_of where len(l) = 1
), top_rows(level, l) as (
  select 0, list(subroot order by r) from subroots union all select level + 1, {_RUNS} from top_rows where len(l) > 1
), steps as (
  select lang, level, l, level as turn, false as top, max(level) over (partition by lang) as height from rows_of
), path as (
  select d.doc_id, d.lang, s.turn, array_to_string(l[(d.r // cast(8 ** level as bigint)) // 8 * 8 + 1:(d.r // cast(8 ** level as bigint))], '') as before,
    array_to_string(l[(d.r // cast(8 ** level as bigint)) + 2:((d.r // cast(8 ** level as bigint)) // 8 + 1) * 8], '') as after
  from (select doc_id, lang, r, 1 as one from ranked) d join (select lang, level, l, turn from steps where len(l) > 1) s on s.lang is not distinct from d.lang
  union all
  select d.doc_id, d.lang, 100 + t.level, array_to_string(l[(u.r // cast(8 ** level as bigint)) // 8 * 8 + 1:(u.r // cast(8 ** level as bigint))], ''),
    array_to_string(l[(u.r // cast(8 ** level as bigint)) + 2:((u.r // cast(8 ** level as bigint)) // 8 + 1) * 8], '')
  from ranked d join subroots u on u.lang is not distinct from d.lang join top_rows t on len(t.l) > 1
), whole as (
  select doc_id, sha256(string_agg(before || after, '' order by turn)) as proof_sha256, list({{'b': before, 'a': after}} order by turn) as steps from path group by doc_id
), folds(doc_id, digest, steps, i) as (
  select d.doc_id, coalesce(other, leaf), coalesce(steps, []), 1 from leaves d left join whole w on w.doc_id = d.doc_id
  union all select doc_id, sha256(steps[i].b || digest || steps[i].a), steps, i + 1 from folds where i <= len(steps)
)
select d.doc_id, leaf, subroot, t.l[1] as root, coalesce(proof_sha256, sha256('')) as proof_sha256, digest as folded_root, digest = t.l[1] as verified
from leaves d join subroots u on u.lang is not distinct from d.lang join top_rows t on len(t.l) = 1
left join whole w on w.doc_id = d.doc_id join folds f on f.doc_id = d.doc_id and i > len(f.steps)
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, by language, in all orders of the filters."""
    from gridfolio.llm.filter_audit import filter_interactions

    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _audit_sql() -> str:
    one = " when ".join(f"'{x}' then {1 << i}" for i, x in enumerate("ABCDE"))
    sums = {
        "kept": "failed & (early | bit) = 0", "removed": "failed & early = 0 and failed & bit > 0", "redundant": "failed & early > 0 and failed & bit > 0", "unique_fails": "failed = bit",
        "good_lost": "failed & early = 0 and failed & bit > 0 and good", "toxic_lost": "failed & early = 0 and failed & bit > 0 and toxic",
    }
    return f"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first from t),
f as (
  select doc_id, part, case when len(words) < 100 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end
    + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) then 4 else 0 end
    + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when first < doc_id then 16 else 0 end as failed from w
), l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
cells as (select part, failed, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n from f left join l on l.doc_id = f.doc_id group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
orders as (select a.c || b.c || d.c || e.c || g.c as filter_order from x a, x b, x d, x e, x g where len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
steps as (
  select filter_order, step, case filter_order[step] when {one} end as bit,
    list_sum(list_transform(range(1, step), lambda k: case filter_order[k] when {one} end)) as early
  from (select filter_order, cast(unnest(range(1, 6)) as integer) as step from orders)
), s as (select filter_order, step, bit, cast(coalesce(early, 0) as bigint) as early from steps),
counts as (
  select part, filter_order, step, bit, {", ".join(f"cast(coalesce(sum(n) filter ({c}), 0) as bigint) as {n}" for n, c in sums.items())}
  from cells cross join s group by all
)
select * exclude (bit), cast(sum(removed) over (partition by part, bit) as bigint) as shapley from counts
"""


CHECKS["op13_filter_audit"] = _audit_sql()


QUERIES["pipeline"] = corpus_pipeline.run
