"""The listed queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import public_tokenizers

from longspan.llm.op1_line_dedup import line_dedup
from longspan.llm.op2_language_id import language_id
from longspan.llm.op3_suffix_dedup import suffix_dedup
from longspan.llm.op4_token_ids import read_tokens, write_tokens
from longspan.llm.op5_toxicity import toxicity
from longspan.llm.op6_decontaminate import decontaminate
from longspan.llm.op7_secrets import secrets
from longspan.llm.op8_mix import mix
from longspan.llm.op9_embedding_dedup import embedding_groups
from longspan.llm.op10_simhash import simhash_groups
from longspan.llm.op11_sentencepiece import encode
from longspan.llm.op12_conversation_trie import conversation_trie
from longspan.llm.op13_hard_negatives import hard_negatives
from longspan.sources.stages import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 or more code points found in 5 or more documents stay in the last one only."""
    kept = line_dedup(given(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by rank-order profiles of its n-grams."""
    return language_id(given(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by a 200-byte string that also starts elsewhere, removed."""
    found = suffix_dedup(given(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids in directly addressable code files, read back by document."""
    path = scratch_path(spark, "tokens")
    write_tokens(given(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a classifier trained on weak labels."""
    found = toxicity(given(spark, sf_dir, "documents"), given(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 benchmark words in every document."""
    found = decontaminate(given(spark, sf_dir, "documents"), given(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by fixed patterns, and what a conditional random field adds."""
    found = secrets(given(spark, sf_dir, "documents"))

    def shown(spans: Column) -> Column:
        text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(text, ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "tagged")
    digest = F.sha2(shown(base), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), digest, shown(F.col("spans")).alias("spans"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 3, 1, 2 over 150% of all words."""
    found = mix(given(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of one label linked at a cosine of 0.93 or more, by cells."""
    return embedding_groups(given(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and the groups linked at 2 or fewer differing bits."""
    found = simhash_groups(given(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document with spans in its bytes, decoded again."""
    found = encode(given(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "spans_crc32",
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations with the totals of their subtrees."""
    return conversation_trie(given(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and its best five of the same label, five near ones of others."""
    return hard_negatives(given(spark, sf_dir, "embeddings"))


OP1_SQL = r"""
with split as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), line as (
  select doc_id, lines, unnest(range(1, len(lines) + 1)) as place from split
), keyed as (
  select doc_id, place, lines[place] as line,
         translate(trim(lines[place], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from line
), frequent as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40
  group by key having count(distinct doc_id) >= 5
)
select k.doc_id, count(*) as n_lines, count(*) filter (f.keeper <> k.doc_id) as n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) order by k.place)
                       filter (f.keeper is null or f.keeper = k.doc_id), '')) as kept_sha256
from keyed k left join frequent f on f.key = k.key
group by k.doc_id
"""

OP6_SQL = r"""
with doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), place as (
  select item_id, w, least(len(w), 10) as size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i
  from item where len(w) > 0
), win as (
  select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as words from place
), gram as (
  select doc_id, s.size, w, unnest(range(1, len(w) - s.size + 2)) as i
  from doc, (select distinct size from win) s
), hit as (
  select g.doc_id, g.i, g.size, win.item_id from gram g
  join win on win.size = g.size and win.words = array_to_string(g.w[g.i:g.i + g.size - 1], ' ')
), hit_word as (
  select doc_id, count(distinct spot) as n from (select doc_id, unnest(range(i, i + size)) as spot from hit) group by doc_id
), hit_item as (
  select doc_id, count(*) as n, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from hit) group by doc_id
)
select doc.doc_id, len(doc.w) as n_words, coalesce(hw.n, 0) as n_hit, coalesce(hi.n, 0) as n_items,
       sha256(coalesce(hi.ids, '')) as items_sha256, coalesce(hw.n, 0) > 0 as contaminated
from doc left join hit_word hw on hw.doc_id = doc.doc_id left join hit_item hi on hi.doc_id = doc.doc_id
"""

OP3_SQL = """
with doc as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents
), start as (
  select doc_id, unnest(range(0, n - 199)) as i from doc where n >= 200
), win as (
  select s.doc_id, s.i, md5(substr(d.h, 2 * s.i + 1, 400)) as m from start s join doc d on d.doc_id = s.doc_id
), again as (
  select doc_id, i from (select *, count(*) over (partition by m) as c from win) where c > 1
), edge as (
  select *, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as fresh from again
), numbered as (
  select *, sum(fresh) over (partition by doc_id order by i) as run from edge
), span as (
  select doc_id, min(i) as s, max(i) + 200 as e from numbered group by doc_id, run
), before as (
  select *, coalesce(lag(e) over (partition by doc_id order by s), 0) as p from span
), cut as (
  select b.doc_id, count(*) as n_spans, sum(e - s) as n_removed, max(e) as last,
         string_agg(substr(d.h, 2 * p + 1, 2 * (s - p)), '' order by s) as kept
  from before b join doc d on d.doc_id = b.doc_id group by b.doc_id
)
select d.doc_id, d.n as n_bytes, cast(coalesce(c.n_removed, 0) as bigint) as n_removed, coalesce(c.n_spans, 0) as n_spans,
       sha256(unhex(coalesce(c.kept || substr(d.h, 2 * c.last + 1), d.h))) as kept_sha256
from doc d left join cut c on c.doc_id = d.doc_id
"""

OP9_SQL = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93
), reach as (
  select vec_id, vec_id as root from embeddings
  union select l.b, r.root from reach r join link l on l.a = r.vec_id
), least_root as (
  select vec_id, min(root) as component_id from reach group by vec_id
), links as (
  select a as vec_id, count(*) as n from link group by a
)
select m.vec_id, coalesce(k.n, 0) as n_links, m.component_id, m.vec_id = m.component_id as kept
from least_root m left join links k on k.vec_id = m.vec_id
"""

# CRC-32 of a decimal number by its bits, as the engine has no such function.
OP12_SQL = """
with spoken as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), own as (
  select conv_id, octet_length(encode(text)) as n_bytes,
         md5(octet_length(encode(role)) || ':' || role || text) as code,
         row_number() over (partition by conv_id order by turn nulls first, role, md5(octet_length(encode(role)) || ':' || role || text)) as place
  from spoken
), conv as (
  select conv_id, conv_id - conv_id % 5 as base, count(*) as n_own,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: ascii(c)::bigint)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
        lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384::bigint else 0::bigint end))), 4294967295::bigint) % 9 as h
  from own group by conv_id
), shape as (
  select c.conv_id, c.base, c.h, c.n_own, least(c.h, coalesce(b.n_own, 0)) as taken from conv c left join conv b on b.conv_id = c.base
), rebuilt as (
  select s.conv_id, o.place as depth, o.code, o.n_bytes from shape s join own o on o.conv_id = s.base and o.place <= s.taken
  union all
  select s.conv_id, o.place - s.h + s.taken, o.code, o.n_bytes from shape s join own o on o.conv_id = s.conv_id and o.place > s.h
), upto as (
  select conv_id, depth, n_bytes, md5(string_agg(code, '') over (partition by conv_id order by depth)) as name,
         depth = max(depth) over (partition by conv_id) as last
  from rebuilt
  union all
  select conv_id, 0, 0, 'root', taken = 0 and n_own <= h from shape
), node as (
  select name, depth, min(conv_id) as conv_id, count(*) as n_convs, max(n_bytes) as n_bytes,
         string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (last) as ends
  from upto group by name, depth
), child as (
  select n.name, n.depth, p.conv_id as parent_conv_id, p.name as up
  from node n join upto u on u.conv_id = n.conv_id and u.depth = n.depth - 1 join node p on p.name = u.name and p.depth = u.depth
), children as (
  select up as name, depth - 1 as depth, count(*) as n from child group by 1, 2
), weight as (
  select n.*, coalesce(c.n, 0) as n_children, (n.n_convs - 1) * n.n_bytes as saved from node n left join children c on c.name = n.name and c.depth = n.depth
), total as (
  select u.name, u.depth, count(*) filter (w.n_children = 0) as n_leaves, cast(sum(w.saved) as bigint) as saved_tokens
  from weight w join upto u on u.conv_id = w.conv_id and u.depth <= w.depth group by 1, 2
)
select w.conv_id, w.depth, c.parent_conv_id, w.n_convs, w.n_children, t.n_leaves, t.saved_tokens, sha256(coalesce(w.ends, '')) as ends_sha256
from weight w join total t on t.name = w.name and t.depth = w.depth left join child c on c.name = w.name and c.depth = w.depth
"""

OP13_SQL = """
with r as (
  select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.row as anchor, a.vec_id as anchor_id, b.row as other, b.vec_id, a.label = b.label as same,
         cast(list_inner_product(a.e, b.e) as bigint) as score
  from r a join r b on len(a.e) = len(b.e) and a.row <> b.row where a.vec_id % 100 = 0
), positive as (
  select * from scored where same qualify row_number() over (partition by anchor order by score desc, vec_id) <= 5
), pair as (
  select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, n.vec_id as negative_id, n.score as negative_score,
         row_number() over (partition by p.anchor, p.other order by n.score desc, n.vec_id) as rank
  from positive p join scored n on n.anchor = p.anchor and not n.same
    and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from pair where rank <= 5
"""

QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_ids": op4_token_ids,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_secrets": op7_secrets,
    "op8_mix": op8_mix,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_simhash": op10_simhash,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL.strip(),
    "op3_suffix_dedup": OP3_SQL.strip(),
    "op6_decontaminate": OP6_SQL.strip(),
    "op9_embedding_dedup": OP9_SQL.strip(),
    "op12_conversation_trie": OP12_SQL.strip(),
    "op13_hard_negatives": OP13_SQL.strip(),
}
