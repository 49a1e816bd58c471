"""The operators and the pipeline as registered queries over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinloom.llm import chat, decontaminate, encode, lengths, merkle, mixing, pii, quality, simhash, tokens, topk, trie, urls, warc
from twinloom.llm.common import table, words

#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: A conversation whose texts hold control strings.
TRICKY = r"\### Assistant: </turn> ok"


def op1_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.judge(table(spark, d, "documents")).drop("reasons")


def op2_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.judged(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op3_token_output(spark: SparkSession, d: str) -> DataFrame:
    return tokens.written(table(spark, d, "documents"))


def op4_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.classed(table(spark, d, "documents"))


def op5_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    one = lambda turn, role: spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(TRICKY).alias("text"))
    rows = rows.unionByName(one(0, "user")).unionByName(one(1, "assistant"))
    back = chat.parsed(chat.formatted(chat.chains(rows)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.reported(table(spark, d, "documents"))


def op7_url_filters(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judged(table(spark, d, "pages"), rules)


def op8_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    from twinloom.session import cut

    docs = table(spark, d, "documents")
    narrow = cut(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")))
    mix = mixing.mixed(narrow, F.col("size"))
    return mix.select(
        "doc_id", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), F.col("_mix_taken").alias("taken"),
        F.round("_mix_first", 6).alias("first_position"))


def op9_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.archived(table(spark, d, "pages"))


def op10_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return lengths.histogram(lengths.lengths(table(spark, d, "documents"), encode.BYTES))


def op11_topk_search(spark: SparkSession, d: str) -> DataFrame:
    return topk.search(table(spark, d, "embeddings"), F.col("id") % topk.EVERY == 0)


def op12_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    return merkle.manifest(table(spark, d, "documents"), merkle.fifth)


def op13_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return trie.report(table(spark, d, "conversations"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_decontamination, op3_token_output, op4_simhash, op5_chat_formatting, op6_pii, op7_url_filters,
        op8_source_mixing, op9_warc, op10_token_counts, op11_topk_search, op12_merkle_manifest, op13_prefix_trie, pipeline,
    )
}

_STOP = ", ".join("'" + w + "'" for w in sorted({x for w in quality.STOP_WORDS for x in (w, w.capitalize())}))
_CHATS = rf"""select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t, role, text from conversations
  union all select -7, x.turn, x.role, '\### Assistant: </turn> ok', x.role, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) x(turn, role)"""
#: CRC-32 by its table of 256 remainders: a list ``t`` to join with, and the checksum of a decimal number.
_CRC = """tab as (select list(c order by i) t from (select i, list_reduce(list_prepend(i, [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end) c from range(256) r(i)))"""


def _crc(number: str) -> str:
    letters = f"list_transform(string_split(cast({number} as varchar), ''), lambda x: cast(ord(x) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {letters}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint)"


def _cell(c: str) -> str:
    return f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')"


_LEAF = " || ".join(_cell(c) for c in merkle.FIELDS)
_LOW = _LEAF.replace(_cell("text"), _cell("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))

SQL = {
    "op1_quality_rules": rf"""
with d as (select row_number() over () k, doc_id, coalesce(text, '') t from documents),
w as (select k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
win as (select k, i, list_aggregate(ws[i:i+7], 'string_agg', ' ') g from (select k, ws, unnest(range(1, len(ws) - 6)) i from w where len(ws) >= 8)),
rep as (select k, i from win qualify count(*) over (partition by k, g) > 1),
cov as (select k, count(distinct j) n from (select k, unnest(range(i, i + 8)) j from rep) group by k),
m as (select w.k, doc_id, cast(len(ws) as bigint) n_words, cast(length(array_to_string(ws, '')) as bigint) word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
  cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines, cast(coalesce(n, 0) as bigint) n_repeat_words,
  len(ls) n_lines, len(list_filter(ws, lambda x: x in ({_STOP}))) n_stop from w left join cov on w.k = cov.k),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * n_words or word_chars > 20 * n_words or 100 * n_symbols > 10 * n_words
    or 100 * n_dup_lines > 60 * n_lines or (n_words >= 100 and 100 * n_stop < n_words)) kept from b""",
    "op2_decontamination": r"""
with w as (select row_number() over () k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
bw as (select distinct item_id, least(len(ws), 10) n, list_aggregate(ws[i:i + 9], 'string_agg', ' ') g from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) i from b where len(ws) > 0)),
dw as (select k, s.n, i, list_aggregate(ws[i:i + s.n - 1], 'string_agg', ' ') g from (select k, s.n, ws, unnest(range(1, len(ws) - s.n + 2)) i from w, (select distinct n from bw) s where len(ws) >= s.n) s),
hit as (select k, item_id, i, dw.n from dw join bw on dw.g = bw.g and dw.n = bw.n),
h as (select k, count(distinct j) n_hit from (select k, unnest(range(i, i + n)) j from hit) group by k),
it as (select k, count(*) n_items, string_agg(s, ',' order by s) names from (select distinct k, cast(item_id as varchar) s from hit) group by k)
select doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from w left join h on w.k = h.k left join it on w.k = it.k""",
    "op5_chat_formatting": rf"""
with c as ({_CHATS})
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, role, text)) turns_sha256,
  cast(coalesce(sum(length(t)) filter (role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(16 + length(replace(replace(replace(r, '\', '\b'), '<', '\l'), '>', '\g')) + length(replace(replace(t, '\', '\b'), '<', '\l'))) as bigint) formatted_chars
from c group by conv_id""",
    "op7_url_filters": r"""
with r(host, path, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p as (select row_number() over () k, page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) end s from pages),
q as (select k, page_id, coalesce(translate(regexp_extract(s, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
  coalesce(regexp_extract(s, '^([^/?#]*)([^?#]*)', 2), '') path from p),
f as (select k, max_by(r.host || r.path, length(r.host || r.path)) rule, max_by(verdict, length(r.host || r.path)) verdict
  from q join r on (q.host = r.host or ends_with(q.host, '.' || r.host)) and starts_with(q.path, r.path) group by k)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from q left join f on q.k = f.k""",
    "op8_source_mixing": r"""
with d as (select row_number() over () k, doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size from documents),
s as (select source, cast(sum(size) as bigint) n from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end wt from s),
o as (select *, 3.0::double * n / wt ratio, row_number() over (order by 3.0::double * n / wt) r from w),
l as (select *, cast((sum(n) over ()) - 3 * coalesce(sum(n) over (order by r rows between unbounded preceding and 1 preceding), 0) as double)
  / cast((sum(wt) over ()) - coalesce(sum(wt) over (order by r rows between unbounded preceding and 1 preceding), 0) as double) lvl from o),
lv as (select min_by(lvl, r) lvl from l where lvl * wt <= 3 * n),
t as (select source, n, wt, least(coalesce((select lvl from lv), (select max(lvl) from l)) * wt, cast(3 * n as double)) target from w),
c as (select d.*, n, wt, target, least(cast(round(target) as bigint), 3 * n) dem,
  cast(coalesce(sum(size) over (partition by d.source order by md5(coalesce(cast(doc_id as varchar), '-') || ':' || size || ':42'), doc_id, size, k rows between unbounded preceding and 1 preceding), 0) as bigint) pos
  from d join t on d.source is not distinct from t.source),
e as (select *, case when n > 0 then dem // n else 0 end p from c),
f as (select *, least(greatest(dem - p * n - pos, 0), size) rest from e),
g as (select *, cast(pos as double) / dem x, case wt when 5 then 1.0 when 2 then 1.0 else 1.0 end area from f)
select doc_id, size, n source_size, target, cast(p * size + rest as bigint) taken,
  case when size > 0 and (p > 0 or rest > 0) then round(case wt when 5 then (sqrt(2.25 - 2.0 * x) - 1.5) / -1.0 when 2 then x
    else case when x < 0.3125 then (sqrt(0.0625 + 3.0 * x) - 0.25) / 1.5 else 0.5 + (sqrt(1.0 + 3.0 * (x - 0.3125)) - 1.0) / 1.5 end end, 6) end first_position
from g""",
    "op9_warc": r"""
with p as (select page_id, encode(coalesce(html, '')) b, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) h from pages),
o as (select h, max(page_id) m from p group by h),
x as (select h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((v >> s) & 31 as int) + 1, 1), '' order by i, s desc) d
  from (select h, i, cast(concat('0x', substr(h, i + 1, 5)) as int) v, unnest([15, 10, 5, 0]) s from (select h, unnest([0, 5, 10, 15, 20, 25, 30, 35]) i from (select distinct h from p))) group by h)
select page_id, cast(n as bigint) payload_bytes, x.d payload_digest, case when page_id = m then 'response' else 'revisit' end record_type,
  case when page_id = m then null else m end refers_to from p join o on p.h = o.h join x on p.h = x.h""",
    "op11_topk_search": """
with v as (select row_number() over () k, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) w from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.k qk, q.vec_id query_id, c.vec_id, cast(list_inner_product(q.w, c.w) as bigint) score from v q join v c on c.k <> q.k where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by qk order by score desc, vec_id) rank, vec_id, score from s qualify rank <= 20""",
    "op12_merkle_manifest": f"""
with recursive {_CRC},
l as (select row_number() over () k, doc_id, source, sha256({_LEAF}) leaf, case when {_crc("doc_id")} % 5 = 0 then sha256({_LOW}) end other from documents, tab),
p as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 slot, count(*) over (partition by source) n from l),
t as (select 0 lv, source, slot, leaf h, n from p
  union all select lv + 1, source, slot // 16, sha256(string_agg(h, '' order by slot)), (n + 15) // 16 from t where n > 1 group by lv, source, slot // 16, n),
sub as (select source, h subroot, row_number() over (order by source nulls first) - 1 slot, count(*) over () n from t where n = 1),
u as (select 0 lv, slot, subroot h, n from sub union all select lv + 1, slot // 16, sha256(string_agg(h, '' order by slot)), (n + 15) // 16 from u where n > 1 group by lv, slot // 16, n),
ts as (select lv, source, slot, coalesce(string_agg(h, '') over (partition by lv, source, slot // 16 order by slot rows between unbounded preceding and 1 preceding), '') b,
  coalesce(string_agg(h, '') over (partition by lv, source, slot // 16 order by slot rows between 1 following and unbounded following), '') a from t where n > 1),
us as (select lv, slot, coalesce(string_agg(h, '') over (partition by lv, slot // 16 order by slot rows between unbounded preceding and 1 preceding), '') b,
  coalesce(string_agg(h, '') over (partition by lv, slot // 16 order by slot rows between 1 following and unbounded following), '') a from u where n > 1),
way as (select k, ts.lv, b, a from p join ts on ts.source is not distinct from p.source and ts.slot = p.slot >> cast(4 * ts.lv as bigint)
  union all select k, 1000 + us.lv, b, a from p join sub on sub.source is not distinct from p.source join us on us.slot = sub.slot >> cast(4 * us.lv as bigint)),
g as (select k, string_agg(b || a, '' order by lv) proof, list({{'b': b, 'h': '', 'a': a}} order by lv) steps from way group by k),
f as (select p.*, subroot, (select h from u where n = 1) root, sha256(coalesce(proof, '')) proof_sha256,
  list_reduce(list_prepend({{'b': '', 'h': coalesce(other, leaf), 'a': ''}}, coalesce(steps, [])), lambda x, y: {{'b': '', 'h': sha256(y.b || x.h || y.a), 'a': ''}}).h folded_root
  from p join sub on sub.source is not distinct from p.source left join g on g.k = p.k)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root verified from f""",
    "op13_prefix_trie": f"""
with {_CRC},
c as (select conv_id, list({{'r': r, 't': t}} order by turn nulls first, r, sha256(octet_length(encode(r)) || ':' || r || t)) l
  from (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations where conv_id is not null) group by conv_id),
h as (select conv_id, l, {_crc("conv_id")} % 6 h from c, tab),
r as (select x.conv_id, list_concat(coalesce(y.l[1:x.h], []), x.l[x.h + 1:]) l from h x left join c y on y.conv_id = x.conv_id - x.conv_id % 100),
p as (select conv_id, d, l[1:d] p, d = len(l) last from (select conv_id, l, unnest(range(0, len(l) + 1)) d from r)),
n as (select p, d, min(conv_id) conv_id, count(*) m, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (last), '')) ends from p group by p, d),
k as (select p[1:d - 1] p, d - 1 d, count(*) kids from n where d > 0 group by 1, 2),
s as (select p[1:e] p, e d, count(*) filter (kids is null) leaves, sum(case when d > 0 then (m - 1) * length(p[d].t) else 0 end) saved
  from (select n.p, n.d, m, kids, unnest(range(0, n.d + 1)) e from n left join k on k.d = n.d and k.p = n.p) group by 1, 2)
select n.conv_id, n.d depth, o.conv_id parent_conv_id, n.m n_convs, coalesce(kids, 0) n_children, leaves n_leaves, cast(saved as bigint) saved_tokens, n.ends ends_sha256
from n join s on s.d = n.d and s.p = n.p left join k on k.d = n.d and k.p = n.p left join n o on o.d = n.d - 1 and o.p = n.p[1:n.d - 1]""",
}
