"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

from . import bpe, brown, classifier, divergence, exact_dedup, language, line_dedup, minhash, mixing, overlap_join, prefix_trie, quality_rules, repeats
from .common import crc_mod, documents


def tokenizers():
    """The module that knows where the public vocabulary files are (``SPANLOOM_TOKENIZERS`` names another folder)."""
    try:
        import public_tokenizers
    except ImportError:
        sys.path.append(os.path.dirname(os.environ.get("SPANLOOM_TOKENIZERS", "/opt/tokenizers")))
        import public_tokenizers
    return public_tokenizers


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(documents(spark, sf_dir), crc_mod("doc_id", 7) == 2)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_classifier(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 4) == 2)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op4_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(documents(spark, sf_dir), crc_mod("doc_id", 3) == 1)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), size=4, percent=80)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    public = tokenizers()
    return bpe.bpe_codec(documents(spark, sf_dir), bpe.read_ranks(public.path("byte_bpe_multi_50k.tiktoken")), public.PATTERN)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_join.overlap_join(documents(spark, sf_dir), size=4, percent=85)


QUERIES = {f.__name__: f for f in (op1_brown_lm, op2_quality_classifier, op3_quality_rules, op4_bwt_dedup, op5_line_dedup, op6_language_id, op7_mixing, op8_minhash_dedup, op9_bpe_codec, op10_exact_dedup, op11_source_divergence, op12_prefix_trie, op13_overlap_join)}

#: Components of documents whose sets of four-word shingles are alike, from all pairs that share a shingle.
_ALIKE = r"""
        with recursive words as (
            select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        shingles as (
            select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] end) as shingle
            from words),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all),
        links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared.n >= {percent} * (x.n + y.n - shared.n)),
        ways as (select a, b from links union all select b, a from links),
        reach as (select a, b from ways union select reach.a, ways.b from reach join ways on reach.b = ways.a),
        least as (select a as doc_id, min(b) as other from reach group by a)
        select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(other, doc_id)) as component_id{more}
        from documents left join sizes using (doc_id) left join least using (doc_id)"""

ORACLES = {
    "op8_minhash_dedup": _ALIKE.format(percent=80, more=", doc_id <= coalesce(other, doc_id) as kept"),
    "op13_overlap_join": _ALIKE.format(percent=85, more=""),
    "op10_exact_dedup": r"""
        with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
        select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
               doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
        from t""",
    "op11_source_divergence": r"""
        with d as (
            select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row_no,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
            from documents),
        words as (select lang, source, row_no, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
        kept as (select lang, term, count(*) as total from words group by lang, term having count(distinct row_no) >= 3),
        langs as (select lang, count(*) as kinds, sum(total)::hugeint as lang_size from kept group by lang),
        counts as (select lang, source, term, count(*) as n from words group by lang, source, term),
        sizes as (select lang, source, sum(n)::hugeint as size from counts join kept using (lang, term) group by lang, source),
        cells as (
            select g.lang, g.source, term, coalesce(n, 0) as n,
                   (1 + (1000000000::hugeint * (coalesce(n, 0) + 1)) // (coalesce(size, 0) + kinds))::bigint as p,
                   (1 + (1000000000::hugeint * (total + 1)) // (lang_size + kinds))::bigint as q
            from (select distinct lang, source from d) g join kept using (lang) join langs using (lang) left join sizes using (lang, source) left join counts using (lang, source, term)),
        pairs as (
            select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
            from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
            union all
            select distinct a.lang, a.source, b.source, 0 from d a join d b on a.lang = b.lang and a.source <> b.source where a.lang not in (select lang from langs)),
        ranked as (
            select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
            union all
            select lang, source, 'term', term, (p - q) * (p - q) // q, row_number() over (partition by lang, source order by (p - q) * (p - q) // q desc, term) from cells where n > 0 and p > q)
        select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 200""",
    "op12_prefix_trie": r"""
        with t as (
            select conv_id as c, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as turn_key, length(coalesce(text, '')) as size,
                   row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as i
            from conversations where conv_id is not null),
        ids as (
            select c, c - c % 100 as base, xor(list_reduce(list_concat([4294967295::ubigint], list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::ubigint)),
                lambda crc, b: list_reduce(list_concat([xor(crc, b)], list_transform(range(8), lambda z: 0::ubigint)),
                    lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint) % 6 as h
            from (select distinct c from t)),
        heads as (select ids.*, (select count(*) from t where t.c = ids.base and t.i < ids.h) as head from ids),
        turns as (
            select heads.c, t.i + 1 as depth, turn_key, size from heads join t on t.c = heads.base and t.i < heads.h
            union all
            select heads.c, head + t.i - h + 1, turn_key, size from heads join t on t.c = heads.c and t.i >= heads.h),
        places as (
            select c, depth, string_agg(turn_key, ',') over (partition by c order by depth) as node, size from turns
            union all
            select c, 0, '', 0 from ids),
        path as (select *, lag(node) over (partition by c order by depth) as parent, depth = max(depth) over (partition by c) as ends from places),
        nodes as (
            select node, depth, any_value(parent) as parent, any_value(size) as size, min(c) as conv_id, count(*) as n_convs,
                   sha256(coalesce(string_agg(case when ends then c::varchar end, ',' order by c), '')) as ends_sha256
            from path group by node, depth),
        children as (select parent, count(*) as n_children from nodes where depth > 0 group by parent),
        full_nodes as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children on children.parent = nodes.node),
        below as (
            select p.node, sum(case when u.n_children = 0 then 1 else 0 end) as n_leaves, sum((u.n_convs - 1) * u.size) as saved_tokens
            from full_nodes u join path p on p.c = u.conv_id and p.depth <= u.depth group by p.node)
        select v.conv_id, v.depth::bigint as depth, up.conv_id as parent_conv_id, v.n_convs, v.n_children, below.n_leaves::bigint as n_leaves, below.saved_tokens::bigint as saved_tokens, v.ends_sha256
        from full_nodes v join below on below.node = v.node left join full_nodes up on v.depth > 0 and up.node = v.parent""",
}
