"""The registered queries: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekeep.llm.align import align_tokenizers
from lakekeep.llm.bpe import encode_decode
from lakekeep.llm.common import only
from lakekeep.llm.hilbert import hilbert_shards
from lakekeep.llm.jaccard import jaccard_components
from lakekeep.llm.langid import identify, training_sample
from lakekeep.llm.line_dedup import dedup_lines
from lakekeep.llm.metric_join import metric_components
from lakekeep.llm.mixing import mix, words
from lakekeep.llm.prefix_trie import prefix_trie
from lakekeep.llm.secret_scan import scan, span_text
from lakekeep.llm.url_filter import judge
from lakekeep.llm.warc import archive_and_read
from lakekeep.llm.winnow import fingerprints
from lakekeep.session import load

Query = Callable[[SparkSession, str], DataFrame]


def held_out() -> Column:
    """Documents that no language is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    samples = training_sample(docs, ~held_out())
    found = identify(only(docs, "doc_id", "text"), samples)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "phrase_rate")


def op2_embedding_join(spark: SparkSession, sf: str) -> DataFrame:
    return metric_components(load(spark, sf, "embeddings"))


def op3_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints(load(spark, sf, "documents")).drop("edited")


def op4_url_reputation(spark: SparkSession, sf: str) -> DataFrame:
    """A page's outcome is its label's, where `labels` has its number: bad when of no quality or toxic."""
    pages = only(load(spark, sf, "pages"), "page_id", "url")
    labels = only(load(spark, sf, "labels"), "doc_id", "quality", "toxic")
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    outcomes = pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", bad.alias("bad"))
    return judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict", "labelled", "labelled_bad")


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    mixed = mix(only(docs, "doc_id", "source", "text").select("doc_id", "source", words().alias("size")))
    first = F.get("positions", F.lit(0))
    placed = mixed.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"))
    return placed.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def op6_hilbert_shards(spark: SparkSession, sf: str) -> DataFrame:
    return hilbert_shards(load(spark, sf, "documents"))


def op7_secret_battery(spark: SparkSession, sf: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scan(only(load(spark, sf, "documents"), "doc_id", "text")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "random")],
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"), span_text(spans).alias("spans"),
    )


def op8_warc_index(spark: SparkSession, sf: str) -> DataFrame:
    return archive_and_read(load(spark, sf, "pages"))


def bpe_digest(docs: DataFrame) -> DataFrame:
    coded = encode_decode(only(docs, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_digest(load(spark, sf, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(load(spark, sf, "documents"))


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align_tokenizers(load(spark, sf, "documents"), *files)


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie(load(spark, sf, "conversations"))


def op13_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    told = dedup_lines(load(spark, sf, "documents"))
    return told.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), "most_docs")


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_embedding_join": op2_embedding_join,
    "op3_winnowing": op3_winnowing,
    "op4_url_reputation": op4_url_reputation,
    "op5_mixing": op5_mixing,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_secret_battery": op7_secret_battery,
    "op8_warc_index": op8_warc_index,
    "op9_bpe": op9_bpe,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_alignment": op11_alignment,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_line_dedup": op13_line_dedup,
}
#: SQL for the queries that it can express.
CHECKS: dict[str, str] = {
    "op2_embedding_join": """
with recursive v as (
  select vec_id, label, embedding::double[] e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(n, m) as (select vec_id, vec_id from embeddings union select r.n, l.b from reach r join links l on r.m = l.a),
least as (select n, min(m) component_id from reach group by n),
held as (select a, count(*) n_links from links group by a)
select e.vec_id, coalesce(h.n_links, 0) n_links, l.component_id, e.vec_id = l.component_id kept
from embeddings e join least l on e.vec_id = l.n left join held h on e.vec_id = h.a""",
    "op4_url_reputation": r"""
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') "host",
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') "path" from pages),
rules(word, text, name, start) as (values
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
ruled as (
  select page_id, arg_max(text, length(text)) rule, arg_max(word, length(text)) word
  from p join rules on ("host" = name or ends_with("host", concat('.', name))) and starts_with("path", start) group by page_id),
outcome as (select p."host", greatest(1 - l.quality, l.toxic) bad from p join labels l on p.page_id = l.doc_id),
servers as (select distinct "host", regexp_replace(regexp_replace(regexp_replace("host", '^.*@', '', 's'), ':[0-9]*$', ''), '\.$', '') s from p),
named as (select "host", s, starts_with(s, '[') or regexp_full_match(s, '[0-9]{1,3}(\.[0-9]{1,3}){3}') lone,
                 case when len(string_split(s, '.')) < 2 then s else concat(string_split(s, '.')[-2], '.', string_split(s, '.')[-1]) end two,
                 string_split(s, '.')[-1] one from servers),
d as (
  select "host", case when lone then s when two in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz')
                    then case when len(string_split(s, '.')) < 3 then s else concat(string_split(s, '.')[-3], '.', two) end else two end dom,
         case when lone then s when two in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz') then two else one end suf from named),
hosts as (select d.*, count(o.bad) n, coalesce(sum(o.bad), 0) bad from d left join outcome o on d."host" = o."host" group by all),
doms as (select dom, suf, sum(n) n, sum(bad) bad from hosts group by all),
tot as (select coalesce(sum(bad) / nullif(sum(n), 0), 0.0) m from hosts),
sufs as (select suf, sum(n) n, sum(bad) bad, any_value(m) m from doms, tot group by suf),
w1 as (select sum(n * (bad / n - m) ** 2) seen, sum(m * (1 - m)) want, sum(n * m * (1 - m)) scale from sufs where n > 0),
k1 as (select case when coalesce(scale, 0) = 0 or scale - want <= 0 or seen <= want then 1000.0
                   else least(1000.0, greatest(2.0, (scale - want) / (seen - want) - 1)) end k from w1),
s2 as (select suf, (bad + k * m) / (n + k) m from sufs, k1),
d1 as (select doms.*, s2.m from doms join s2 using (suf)),
w2 as (select sum(n * (bad / n - m) ** 2) seen, sum(m * (1 - m)) want, sum(n * m * (1 - m)) scale from d1 where n > 0),
k2 as (select case when coalesce(scale, 0) = 0 or scale - want <= 0 or seen <= want then 1000.0
                   else least(1000.0, greatest(2.0, (scale - want) / (seen - want) - 1)) end k from w2),
d2 as (select dom, suf, (bad + k * m) / (n + k) m from d1, k2),
h1 as (select hosts.*, d2.m from hosts join d2 using (dom, suf)),
w3 as (select sum(n * (bad / n - m) ** 2) seen, sum(m * (1 - m)) want, sum(n * m * (1 - m)) scale from h1 where n > 0),
k3 as (select case when coalesce(scale, 0) = 0 or scale - want <= 0 or seen <= want then 1000.0
                   else least(1000.0, greatest(2.0, (scale - want) / (seen - want) - 1)) end k from w3),
h2 as (select "host", n, bad, (bad + k * m) / (n + k) share, n + k size from h1, k3)
select p.page_id, p."host", p."path", r.rule,
       coalesce(r.word, case when share - 1.645 * sqrt(share * (1 - share) / (size + 1)) > 0.5 then 'block' else 'allow' end) verdict,
       h2.n labelled, cast(h2.bad as bigint) labelled_bad
from p left join ruled r using (page_id) join h2 on p."host" = h2."host"
""",
    "op5_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 k from d group by source),
w as (select *, [5.0, 2.0, 1.0][k % 3 + 1]::double weight, [0.5, 0.0, -0.5][k % 3 + 1]::double slope, (source_size * 3)::double cap from s),
f as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over earlier, 0.0))
            / nullif(sum(weight) over () - coalesce(sum(weight) over earlier, 0.0), 0.0) as level
  from w window earlier as (order by cap / weight, k rows between unbounded preceding and 1 preceding)),
settled as (select arg_min(level, struct_pack(r := cap / weight, k := k)) level from f where level * weight <= cap),
t as (select source, source_size, slope, least(cap, coalesce(settled.level * weight, cap)) target from f, settled),
placed as (
  select d.doc_id, d.size, t.source_size, t.slope, t.target,
         coalesce(sum(d.size) over (partition by d.source order by md5(coalesce(d.doc_id::varchar, '')), d.doc_id, d.size
                                    rows between unbounded preceding and 1 preceding), 0)::bigint "before",
         case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end::bigint rounds
  from d join t on d.source is not distinct from t.source),
taken as (
  select *, case when size > 0 then rounds + case when "before" + size / 2 <= target - rounds * source_size and rounds < 3 then 1 else 0 end
            else 0 end copies, least(1.0, "before" / target) u from placed)
select doc_id, size, source_size, target, size * copies taken,
       case when copies > 0 then 2 * u / ((1 + slope) + sqrt(greatest((1 + slope) * (1 + slope) - 4 * slope * u, 0.0))) end first_position
from taken""",
    "op8_warc_index": """
with p as (select page_id, encode(coalesce(html, '')) payload from pages),
d as (select page_id, octet_length(payload) payload_bytes, sha1(payload) payload_digest from p),
last as (select payload_digest, payload_bytes, max(page_id) m from d where payload_bytes >= 1000 group by all)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when l.m <> d.page_id then 'revisit' else 'response' end record_type,
       case when l.m <> d.page_id then l.m end refers_to
from d left join last l on d.payload_digest = l.payload_digest and d.payload_bytes = l.payload_bytes""",
    "op10_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') w from documents),
sh as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from w),
n as (select doc_id, count(*) n from sh group by doc_id),
met as (select a.doc_id a, b.doc_id b, count(*) i from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
reach(n, m) as (select doc_id, doc_id from documents union select r.n, l.b from reach r join links l on r.m = l.a),
least as (select n doc_id, min(m) component_id from reach group by n)
select doc_id, coalesce(n.n, 0) n_shingles, component_id from documents join least using (doc_id) left join n using (doc_id)""",
    "op12_prefix_trie": r"""
with t as (
  select conv_id, coalesce(role, '') role, coalesce(text, '') text, row_number() over (
           partition by conv_id order by turn nulls first,
                        md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 idx
  from conversations where conv_id is not null),
-- crc32, bit by bit
c as (select conv_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
                                 lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::bigint) % 4 h
      from (select distinct conv_id from t)),
b as (select c.conv_id, t.idx place, role, text from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and t.idx < c.h),
m as (select c.conv_id, c.h, count(b.place) m from c left join b on b.conv_id = c.conv_id group by all),
r as (select * from b union all select t.conv_id, m.m + t.idx - m.h, role, text from t join m on t.conv_id = m.conv_id where t.idx >= m.h),
s as (select c.conv_id, coalesce(list(struct_pack(r := role, t := text) order by place) filter (where place is not null), []) turns
      from c left join r on c.conv_id = r.conv_id group by c.conv_id),
p as (select conv_id, unnest(range(len(turns) + 1)) depth, turns from s),
k as (select conv_id, depth, md5(turns[1:depth]::json::varchar) node, case when depth > 0 then md5(turns[1:depth - 1]::json::varchar) end parent,
             case when depth > 0 then turns[depth].t else '' end last, len(turns) = depth stops from p),
n as (select node, depth, any_value(parent) parent, min(conv_id) conv_id, count(*) n_convs,
             len(regexp_extract_all(any_value(last), '[^ 	-
]+')) words,
             sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (stops), '')) ends_sha256
      from k group by node, depth),
ch as (select parent, count(*) n_children from n group by parent),
f as (select n.*, coalesce(n_children, 0) n_children from n left join ch on n.node = ch.parent),
up as (select f.node, a.node top from f join k a on a.conv_id = f.conv_id and a.depth <= f.depth),
sums as (select top, count(*) filter (n_children = 0) n_leaves, sum((n_convs - 1) * words)::bigint saved_tokens from up join f on up.node = f.node group by top)
select f.conv_id, f.depth, q.conv_id parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
from f join sums on f.node = sums.top left join n q on f.parent = q.node""",
    "op13_line_dedup": r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) lines, row_number() over () r from documents),
l as (select r, doc_id, unnest(lines) line, unnest(range(len(lines))) i from d),
k as (select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') "key" from l),
held as (select "key", count(distinct r) n, max(doc_id) keeper from k where length("key") >= 20 group by "key" having count(distinct r) >= 3),
told as (select k.*, case when h.keeper is distinct from k.doc_id then h.n end gone from k left join held h on k."key" = h."key")
select doc_id, count(*) n_lines, count(gone) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (gone is null), '')) kept_sha256,
       coalesce(max(gone), 0) most_docs
from told group by r, doc_id""",
}
