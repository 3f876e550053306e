"""The queries over whole tables that apply each operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import doubling, mixing, order_minhash, packing, patched_frames, posting_lists, prefix_counts, prefix_trie, repair, resampling, rules, sharding, toxicity
from .base import table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf_dir, "documents"), 24)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patched_frames.written_and_read(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file(), limit=512)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.neighbours(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(), cap=2048, end_id=0)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), group=20, most=4)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling.deduplicated(table(spark, sf_dir, "documents"), window=13)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_near_dedup, op2_sharding, op3_toxicity, op4_mixing, op5_token_files, op6_quality_rules, op7_quality_classifier, op8_token_counts, op9_nearest_neighbours, op10_packing, op11_prefix_trie, op12_conversation_repair, op13_substring_dedup)}


#: op4: the same apportionment and block order over one prefix sum a source.
MIXING_SQL = r"""
with sized as (select doc_id, source, coalesce('=' || source, 'null') k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size, md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) seed from documents),
per_source as (select k, max(source) source, sum(size)::bigint source_size from sized group by k),
weighed as (select *, row_number() over (order by source nulls last) nth, (sum(source_size) over ())::bigint total, source_size * 2.0::double most, ([3, 1, 2])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double weight from per_source),
levels as (select *, (1.5::double * total - (sum(most) over w - most)) / (sum(weight) over () - (sum(weight) over w - weight)) lvl from weighed window w as (order by most / weight, nth rows between unbounded preceding and current row)),
targets as (select k, nth, source_size, least(most, max(lvl) over () * weight) target, total, greatest(1, least(1024, total // 65536, coalesce(min(nullif(source_size, 0)) over (), 0) // 64))::bigint block, count(*) over () n from levels),
parts as (select *, floor(1.5::double * total / block)::bigint seats, target / greatest(1::double, 1.5::double * total) part from targets),
bounds as (select *, greatest(0, floor(part * (upto - n / 2 - 1) + 0.5))::bigint won, (case when part > 0 then ceil(part * (upto + n / 2 + 1)) + 1 else 0 end)::bigint most_seats from (select *, seats * shard // 16 upto from parts, (select unnest(generate_series(1, 16)) shard))),
ranked as (select shard, nth, row_number() over (partition by shard order by target / (2 * seat - 1) desc, nth) place from (select shard, nth, target, unnest(generate_series(won + 1, most_seats)) seat from bounds where most_seats > won)),
open_seats as (select shard, any_value(upto) - sum(won) n_open from bounds group by shard),
gained as (select shard, nth, count(*) g from ranked join open_seats using (shard) where place <= n_open group by shard, nth),
upto_shard as (select nth, shard, won + coalesce(g, 0) seats_upto from bounds left join gained using (shard, nth)),
per_shard as (select *, seats_upto - lag(seats_upto, 1, 0) over (partition by nth order by shard) own from upto_shard),
lists as (select nth, max(seats_upto) filter (shard = 16) quota, string_agg(own::bigint::varchar, ',' order by shard) shard_quotas from per_shard group by nth),
quotas as (select p.*, quota, shard_quotas, greatest(1, ceil(source_size / block))::bigint blocks, ('0x' || substr(md5('mix:' || k), 1, 8))::bigint shift from parts p join lists using (nth)),
known as (select *, case when blocks % 1000003 <> 0 then 1000003 when blocks % 1000033 <> 0 then 1000033 when blocks % 1000037 <> 0 then 1000037 else 1000039 end stride from quotas),
placed as (select s.doc_id, s.source, s.size, known.*, (sum(s.size) over (partition by s.k order by seed, s.doc_id nulls first, s.size rows between unbounded preceding and current row) - s.size)::bigint f from sized s join known on s.k = known.k),
each as (select *, unnest(case when size > 0 then generate_series(f // block, (f + size - 1) // block) else [-1::bigint] end) b from placed)
select doc_id, any_value(block) block, any_value(quota)::bigint quota, any_value(shard_quotas) shard_quotas, any_value(source) source, any_value(size) size, any_value(source_size) source_size, any_value(target) target,
 sum(case when b < 0 then 0 else (least(f + size, (b + 1) * block) - greatest(f, b * block)) * least(2, quota // blocks + ((stride * b + shift) % blocks < quota % blocks)::int) end)::bigint taken
from each group by doc_id"""


#: op11: nodes by their whole sequences of turns; a subtree is all nodes that begin with one. Turns of one place in a conversation are told apart by role and text.
TRIE_SQL = r"""
with own as (select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) turns from conversations where conv_id is not null group by conv_id),
h as (select conv_id, turns, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 h from own),
rebuilt as (select a.conv_id, list_concat(coalesce(b.turns, [])[:a.h], a.turns[a.h + 1:]) turns from h a left join own b on b.conv_id = a.conv_id - a.conv_id % 20),
steps as (select conv_id, depth, turns[:depth] path, len(turns) = depth as ended from (select conv_id, turns, unnest(generate_series(0, len(turns))) depth from rebuilt)),
nodes as (select path, any_value(depth) depth, min(conv_id) conv_id, count(*) n_convs, string_agg(case when ended then conv_id::varchar end, ',' order by conv_id) ends from steps group by path),
kids as (select path[:depth - 1] path, count(*) n from nodes where depth > 0 group by 1),
each as (select nodes.*, coalesce(kids.n, 0) n_children, (n_convs - 1) * coalesce(len(regexp_extract_all(path[-1].text, '[^\x20\x09-\x0D]+')), 0) saves from nodes left join kids using (path)),
sums as (select a.path, count(*) filter (b.n_children = 0) leaves, sum(b.saves) saved from each a join each b on b.path[:a.depth] = a.path group by a.path)
select e.conv_id, e.depth::bigint depth, p.conv_id parent_conv_id, e.n_convs, e.n_children, leaves n_leaves, coalesce(saved, 0)::bigint saved_tokens, sha256(coalesce(e.ends, '')) ends_sha256
from each e join sums using (path) left join nodes p on e.depth > 0 and p.path = e.path[:e.depth - 1]"""

#: op13: all windows at once, and longer ones from the repeated ones level by level.
SUBSTRING_SQL = r"""
with recursive split as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
base as (select doc_id, s, md5(array_to_string(w[s:s + 12], ' ')) h from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) s from split where len(w) >= 13)),
judged as (select *, min(doc_id) over (partition by h) first, max(doc_id) over (partition by h) last from base),
levels as (select 13::bigint length, doc_id, s, h from judged where first < last
 union all select length * 2, doc_id, s, h from (select *, min(doc_id) over (partition by h) first, max(doc_id) over (partition by h) last
  from (select a.length, a.doc_id, a.s, md5(a.h || b.h) h from levels a join levels b on a.doc_id = b.doc_id and b.s = a.s + a.length)) where first < last),
gone as (select distinct doc_id, s + k place from judged, (select unnest(generate_series(0, 12)) k) where first < doc_id),
kept as (select doc_id, string_agg(word, ' ' order by place) text from (select doc_id, unnest(w) word, generate_subscripts(w, 1) place from split) anti join gone using (doc_id, place) group by doc_id)
select split.doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(kept.text, '')) kept_sha256, coalesce(longest, 0)::bigint longest
from split left join kept using (doc_id) left join (select doc_id, count(*) n from gone group by doc_id) using (doc_id) left join (select doc_id, max(length) longest from levels group by doc_id) using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The other operators' results can't be had in SQL; tests hold them against brute force."""
    return {"op4_mixing": MIXING_SQL, "op11_prefix_trie": TRIE_SQL, "op13_substring_dedup": SUBSTRING_SQL}
