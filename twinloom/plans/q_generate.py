"""Checked queries: row, text and graph generation. Each generates as many rows as the table it was fitted on."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinloom.operators import generate as G, graph, text as X
from twinloom.plans import q_runs, views as V
from twinloom.plans.q_tables import SQL as TABLE_SQL, laplace_sql, normal_sql, pick_sql, u_sql
from twinloom.sources import registry, tables as T

QUERIES, SQL = {}, {}


def r4(x):
    return F.round(x, 4)


def rounded(df, *cols):
    """Four places: generated prices carry about eleven digits before the engines' last-digit differences show."""
    return df.select(*[r4(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


NUM = ["l_quantity", "l_extendedprice", "l_discount"]
CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]


def li(s, d):
    return T.load_table(s, d, "lineitem")


def n_rows(s, d, t):
    return T.load_table(s, d, t).count()


def base_sql(t):
    return f"base as (select unnest(range((select count(*) from {t}))) row_id)"


def clip_sql(x, lo, hi):
    return f"(case when {x}<{lo} then {lo} when {x}>{hi} then {hi} else {x} end)"


def stats_sql(t, cols, sd="stddev_pop"):
    return "st as (select count(*)::double n, " + ", ".join(f"avg({c}) m_{c}, greatest({sd}({c}),1e-6) s_{c}, min({c})::double lo_{c}, max({c})::double hi_{c}" for c in cols) + f" from {t})"


def numeric_sql(c, eps=1.0, seed=42):
    x = f"(m_{c}+s_{c}*{normal_sql('row_id', c, seed)}+{laplace_sql('row_id', c + '/noise', f'((hi_{c}-lo_{c})/({eps}*greatest(n,1)+1e-6))', seed)})"
    return f"{clip_sql(x, f'lo_{c}', f'hi_{c}')}"


QUERIES["gen_numeric"] = lambda s, d: rounded(G.gen_numeric(li(s, d), NUM, n_rows(s, d, "lineitem")), *NUM)
SQL["gen_numeric"] = f"with {base_sql('lineitem')}, {stats_sql('lineitem', NUM)} select row_id, {', '.join(f'round({numeric_sql(c)},4) {c}' for c in NUM)} from base, st"


def iv_sql(name, t, col, by=None):
    p = f"partition by {by}" if by else ""
    b = f"{by}, " if by else ""
    w = f"sum(n) over ({p} order by md5(value::varchar) rows unbounded preceding)"
    return f"""{name} as (select {b}value, ({w}-n)::double/sum(n) over ({p}) lo, ({w})::double/sum(n) over ({p}) hi
 from (select {b}{col} value, count(*) n from {t} where {col} is not null group by all))"""


QUERIES["gen_categorical"] = lambda s, d: G.gen_categorical(li(s, d), CATS, n_rows(s, d, "lineitem"))
SQL["gen_categorical"] = f"with {base_sql('lineitem')}, " + ", ".join(iv_sql(f"iv_{c}", "lineitem", c) for c in CATS) + \
    ", b as (select row_id, " + ", ".join(f"{u_sql('row_id', c)} u_{c}" for c in CATS) + " from base) select row_id, " + \
    ", ".join(f"iv_{c}.value {c}" for c in CATS) + " from b " + " ".join(f"join iv_{c} on u_{c}>=iv_{c}.lo and u_{c}<iv_{c}.hi" for c in CATS)

QUERIES["gen_labels"] = lambda s, d: G.gen_labels(T.load_table(s, d, "customer"), "c_name", n_rows(s, d, "customer"))
SQL["gen_labels"] = f"with {base_sql('customer')}, {iv_sql('iv', 'customer', 'c_name')}, b as (select row_id, {u_sql('row_id', 'c_name')} u from base) select row_id, value c_name from b join iv on u>=lo and u<hi"


def temporal(s, d):
    g = G.gen_numeric(T.load_table(s, d, "orders"), ["o_totalprice", "o_custkey"], n_rows(s, d, "orders"))
    return rounded(G.gen_temporal(g, "o_totalprice"), "o_totalprice", "o_custkey")


QUERIES["gen_temporal"] = temporal
SQL["gen_temporal"] = f"""with {base_sql('orders')}, {stats_sql('orders', ['o_totalprice', 'o_custkey'])}, g as (select row_id, {numeric_sql('o_totalprice')} p, {numeric_sql('o_custkey')} c from base, st)
 select row_id, round(p,4) o_totalprice, round(c,4) o_custkey, row_number() over (order by p, row_id) "sequence" from g"""

OTHER = ["o_orderstatus", "o_orderpriority"]
QUERIES["gen_bootstrap"] = lambda s, d: rounded(G.gen_bootstrap(T.load_table(s, d, "orders"), "o_orderkey", ["o_totalprice"], OTHER, n_rows(s, d, "orders")), "o_totalprice")
IDX = f"ix as (select *, row_number() over (order by {u_sql('o_orderkey', 'index')}, o_orderkey)-1 idx from orders)"


def at_sql(tag):
    return f"least(floor({u_sql('row_id', tag)}*n)::bigint, n::bigint-1)"


SQL["gen_bootstrap"] = f"""with {base_sql('orders')}, {stats_sql('orders', ['o_totalprice'], 'stddev_samp')}, {IDX}, b as (select row_id, m_o_totalprice+s_o_totalprice*{normal_sql('row_id', 'o_totalprice')} p,
 {at_sql('o_orderstatus/boot')} i1, {at_sql('o_orderpriority/boot')} i2 from base, st)
 select row_id, round(p,4) o_totalprice, a.o_orderstatus, c.o_orderpriority from b join ix a on a.idx=i1 join ix c on c.idx=i2"""

QUERIES["gen_bootstrap_rows"] = lambda s, d: rounded(G.bootstrap_rows(T.load_table(s, d, "orders"), "o_orderkey", n_rows(s, d, "orders")).drop("o_orderdate"), "o_totalprice")
SQL["gen_bootstrap_rows"] = f"""with {base_sql('orders')}, st as (select count(*) n from orders), {IDX}, b as (select row_id, {at_sql('rows/boot')} i from base, st)
 select row_id, o_orderkey, o_custkey, o_orderstatus, round(o_totalprice,4) o_totalprice, o_orderpriority from b join ix on idx=i"""


def conditional(s, d):
    real = li(s, d)
    labels = G.gen_labels(real, "l_returnflag", real.count())
    return rounded(G.gen_conditional(real, labels, "l_returnflag", NUM, ["l_linestatus"]), *NUM)


QUERIES["gen_conditional"] = conditional
LABELS = f"{base_sql('lineitem')}, {iv_sql('ivl', 'lineitem', 'l_returnflag')}, lab as (select row_id, value l_returnflag from (select row_id, {u_sql('row_id', 'l_returnflag')} u from base) join ivl on u>=lo and u<hi)"
CLASS_STATS = "cs as (select l_returnflag k, " + ", ".join(f"avg({c}) m_{c}, greatest(coalesce(stddev_samp({c}),1e-6),1e-6) s_{c}, min({c}) lo_{c}, max({c}) hi_{c}, count(distinct {c}) d_{c}" for c in NUM) + " from lineitem group by 1)"


def cond_num(c):
    x = f"(m_{c}+s_{c}*{normal_sql('row_id', c + '/z')})"
    return f"round(case when d_{c}<30 then iv_{c}.value else {clip_sql(x, f'lo_{c}', f'hi_{c}')} end,4) {c}"


SQL["gen_conditional"] = f"with {LABELS}, {CLASS_STATS}, {iv_sql('ivs', 'lineitem', 'l_linestatus', 'l_returnflag')}, " + \
    ", ".join(iv_sql(f"iv_{c}", "lineitem", c, "l_returnflag") for c in NUM) + \
    ", b as (select *, " + u_sql('row_id', 'l_linestatus/cond') + " us, " + ", ".join(f"{u_sql('row_id', c + '/cond')} u_{c}" for c in NUM) + \
    " from lab) select row_id, b.l_returnflag, ivs.value l_linestatus, " + ", ".join(cond_num(c) for c in NUM) + \
    " from b join cs on k=b.l_returnflag join ivs on ivs.l_returnflag=b.l_returnflag and us>=ivs.lo and us<ivs.hi " + \
    " ".join(f"left join iv_{c} on d_{c}<30 and iv_{c}.l_returnflag=b.l_returnflag and u_{c}>=iv_{c}.lo and u_{c}<iv_{c}.hi" for c in NUM)

QUERIES["gen_ids"] = lambda s, d: G.gen_ids(T.load_table(s, d, "pages").select("page_id", "url"), "page_id")
SQL["gen_ids"] = "select page_id, url, 'synth_'||substr(md5(page_id::varchar),1,8)||'.png' synthetic_id from pages"


def metadata(s, d):
    real = registry.demo_metadata(T.load_table(s, d, "orders"), "o_orderkey")
    return rounded(G.gen_metadata(real, "image_path", ["patient_id", "label", "finding", "gender"], ["age"], n_rows(s, d, "orders")), "age")


QUERIES["gen_metadata"] = metadata
MCATS = ["patient_id", "label", "finding", "gender"]
SQL["gen_metadata"] = f"with demo as ({TABLE_SQL['demo_metadata']}), {base_sql('orders')}, {stats_sql('demo', ['age'], 'stddev_samp')}, " + ", ".join(iv_sql(f"iv_{c}", "demo", c) for c in MCATS) + \
    ", b as (select row_id, " + ", ".join(f"{u_sql('row_id', c)} u_{c}" for c in MCATS) + " from base) select row_id, " + ", ".join(f"iv_{c}.value {c}" for c in MCATS) + \
    f", 'synth_'||substr(md5(row_id::varchar),1,8)||'.png' image_path, round({numeric_sql('age')},4) age from b " + " ".join(f"join iv_{c} on u_{c}>=iv_{c}.lo and u_{c}<iv_{c}.hi" for c in MCATS) + ", st"

GAUSS = [c for c, _ in V.columns_of("orders") if c != "o_orderkey"]
QUERIES["gen_gaussian"] = lambda s, d: rounded(G.gen_gaussian(T.load_table(s, d, "orders"), "o_orderkey"), *GAUSS)
SQL["gen_gaussian"] = "select o_orderkey, " + ", ".join(f"case when {c} is not null then round({normal_sql('o_orderkey', c)},4) end {c}" for c in GAUSS) + " from orders"

QUERIES["gen_correlated"] = lambda s, d: rounded(G.gen_correlated(li(s, d), NUM, n_rows(s, d, "lineitem")), *NUM)
A, B, C = NUM


def chol_sql(by=""):
    g = f"{by} k, " if by else ""
    tail = "group by 1" if by else ""
    return f"""cv as (select {g}avg({A}) ma, avg({B}) mb, avg({C}) mc, covar_pop({A},{A}) aa, covar_pop({B},{A}) ba, covar_pop({B},{B}) bb, covar_pop({C},{A}) ca, covar_pop({C},{B}) cb, covar_pop({C},{C}) cc from lineitem {tail}),
 l1 as (select *, sqrt(aa) l11, ba/sqrt(aa) l21, ca/sqrt(aa) l31 from cv), l2 as (select *, sqrt(bb-l21*l21) l22 from l1), l3 as (select *, (cb-l31*l21)/l22 l32 from l2), lo as (select *, sqrt(cc-l31*l31-l32*l32) l33 from l3)"""


ZS = f"{normal_sql('row_id', A + '/z')} z1, {normal_sql('row_id', B + '/z')} z2, {normal_sql('row_id', C + '/z')} z3"
MIX = f"ma+l11*z1 {A}, mb+l21*z1+l22*z2 {B}, mc+l31*z1+l32*z2+l33*z3 {C}"
SQL["gen_correlated"] = f"with {base_sql('lineitem')}, {chol_sql()}, g as (select row_id, {MIX} from (select row_id, {ZS} from base), lo) select row_id, {', '.join(f'round({c},4) {c}' for c in NUM)} from g"


def by_class(s, d):
    real = li(s, d)
    labels = G.gen_labels(real, "l_returnflag", real.count())
    return rounded(G.gen_correlated_by_class(real, labels, "l_returnflag", NUM), *NUM)


QUERIES["gen_correlated_by_class"] = by_class
SQL["gen_correlated_by_class"] = f"with {LABELS}, {chol_sql('l_returnflag')}, g as (select row_id, l_returnflag, {MIX} from (select row_id, l_returnflag, {ZS} from lab) join lo on k=l_returnflag) select row_id, l_returnflag, {', '.join(f'round({c},4) {c}' for c in NUM)} from g"


def copula(s, d):
    real = T.load_table(s, d, "orders")
    return rounded(G.gen_copula(real, ["o_totalprice", "o_custkey"], real.count()), "o_totalprice", "o_custkey")


QUERIES["gen_copula"] = copula
SQL["gen_copula"] = f"""with {base_sql('orders')}, cv as (select avg(o_totalprice) ma, avg(o_custkey) mb, covar_pop(o_totalprice,o_totalprice) aa, covar_pop(o_custkey,o_totalprice) ba, covar_pop(o_custkey,o_custkey) bb from orders),
 lo as (select *, sqrt(aa) l11, ba/sqrt(aa) l21, sqrt(bb-(ba/sqrt(aa))*(ba/sqrt(aa))) l22 from cv),
 g as (select row_id, ma+l11*z1 p, mb+l21*z1+l22*z2 c from (select row_id, {normal_sql('row_id', 'o_totalprice/z')} z1, {normal_sql('row_id', 'o_custkey/z')} z2 from base), lo),
 r as (select row_id, row_number() over (order by p,row_id) rp, row_number() over (order by c,row_id) rc from g),
 o as (select o_totalprice, o_custkey, row_number() over (order by o_totalprice,o_orderkey) kp, row_number() over (order by o_custkey,o_orderkey) kc from orders)
 select row_id, round(a.o_totalprice,4) o_totalprice, round(b.o_custkey::double,4) o_custkey from r join o a on a.kp=rp join o b on b.kc=rc"""


def blend_num(s, d):
    real = T.load_table(s, d, "events")
    n = real.count()
    cols = ["value", "user_id"]
    return rounded(G.blend_numeric(real, G.gen_numeric(real, cols, n, 0.5, 1), G.gen_correlated(real, cols, n, 2), cols), *cols)


QUERIES["blend_numeric"] = blend_num
CV2 = "cv as (select avg(value) ma, avg(user_id) mb, covar_pop(value,value) aa, covar_pop(user_id,value) ba, covar_pop(user_id,user_id) bb from events), lo as (select *, sqrt(aa) l11, ba/sqrt(aa) l21, sqrt(bb-(ba/sqrt(aa))*(ba/sqrt(aa))) l22 from cv)"


def ks_sql(name, cand, c):
    return f"""{name} as (select 1/(max(abs(fr-fs))+1e-6) w from (select sum(r) over o::double/sum(r) over () fr, sum(s) over o::double/sum(s) over () fs from
 (select v, sum(1-f) r, sum(f) s from (select {c}::double v, 0 f from events union all select {c}, 1 from {cand}) group by 1) window o as (order by v rows unbounded preceding)))"""


SQL["blend_numeric"] = f"""with {base_sql('events')}, {stats_sql('events', ['value', 'user_id'])}, a as (select row_id, {numeric_sql('value', 0.5, 1)} "value", {numeric_sql('user_id', 0.5, 1)} user_id from base, st), {CV2},
 b as (select row_id, ma+l11*z1 "value", mb+l21*z1+l22*z2 user_id from (select row_id, {normal_sql('row_id', 'value/z', 2)} z1, {normal_sql('row_id', 'user_id/z', 2)} z2 from base), lo),
 {ks_sql('av', 'a', '"value"')}, {ks_sql('bv', 'b', '"value"')}, {ks_sql('au', 'a', 'user_id')}, {ks_sql('bu', 'b', 'user_id')}
 select row_id, round(a."value"*(av.w/(av.w+bv.w))+b."value"*(bv.w/(av.w+bv.w)),4) "value", round(a.user_id*(au.w/(au.w+bu.w))+b.user_id*(bu.w/(au.w+bu.w)),4) user_id
 from a join b using (row_id), av, bv, au, bu"""


def blend_cat(s, d):
    real = T.load_table(s, d, "orders")
    n = real.count()
    return G.blend_categorical(real, G.gen_categorical(real, OTHER, n, 1), G.gen_bootstrap(real, "o_orderkey", [], OTHER, n, 2), OTHER)


def boot_only(c, i, seed):
    return f"least(floor({u_sql('row_id', c + '/boot', seed)}*n)::bigint, n-1) {i}"


def jsd_pair_sql(name, cand, c):
    return f"""{name} as (select sqrt(greatest(0,sum((p*ln(p/((p+q)/2))+q*ln(q/((p+q)/2)))/2))) dist from (select (r/sum(r) over ()+1e-8)/(1+count(*) over ()*1e-8) p, (s/sum(s) over ()+1e-8)/(1+count(*) over ()*1e-8) q from
 (select v, sum(1-f) r, sum(f) s from (select {c} v, 0 f from orders union all select {c}, 1 from {cand}) group by 1)))"""


QUERIES["blend_categorical"] = blend_cat
SQL["blend_categorical"] = f"with {base_sql('orders')}, st as (select count(*) n from orders), ix as (select *, row_number() over (order by {u_sql('o_orderkey', 'index', 2)}, o_orderkey)-1 idx from orders), " + \
    ", ".join(iv_sql(f"iv_{c}", "orders", c) for c in OTHER) + ", ba as (select row_id, " + ", ".join(f"{u_sql('row_id', c, 1)} u_{c}" for c in OTHER) + " from base), a as (select row_id, " + \
    ", ".join(f"iv_{c}.value {c}" for c in OTHER) + " from ba " + " ".join(f"join iv_{c} on u_{c}>=iv_{c}.lo and u_{c}<iv_{c}.hi" for c in OTHER) + \
    f"), bb as (select row_id, {boot_only('o_orderstatus', 'i1', 2)}, {boot_only('o_orderpriority', 'i2', 2)} from base, st), b as (select row_id, x.o_orderstatus, y.o_orderpriority from bb join ix x on x.idx=i1 join ix y on y.idx=i2), " + \
    ", ".join(jsd_pair_sql(f"d{k}{i}", k, c) for k in "ab" for i, c in enumerate(OTHER)) + " select row_id, " + \
    ", ".join(f"case when da{i}.dist<=db{i}.dist then a.{c} else b.{c} end {c}" for i, c in enumerate(OTHER)) + " from a join b using (row_id), da0, da1, db0, db1"

# ---- graph
QUERIES["sequence_edges"] = lambda s, d: graph.sequence_edges(T.load_table(s, d, "events"), "event_id", "ts")
NEXT = "nx as (select event_id a, lead(event_id) over (order by ts) b from events)"
EDGES = f"{NEXT}, edges as (select a src, b dst from nx where b is not null union all select b, a from nx where b is not null)"
SQL["sequence_edges"] = f"with {EDGES} select src, dst from edges"


def neigh(s, d):
    e = T.load_table(s, d, "events")
    return rounded(graph.neighbour_mean(e, graph.sequence_edges(e, "event_id", "ts"), "event_id", ["value", "user_id"]), "value", "user_id")


QUERIES["neighbour_mean"] = neigh
SQL["neighbour_mean"] = f"""with {EDGES}, alln as (select event_id k, value::double v, user_id::double u from events union all select src, value, user_id from edges join events on event_id=dst)
 select k event_id, count(*) degree, round(avg(v),4) "value", round(avg(u),4) user_id from alln group by 1"""

QUERIES["noise_calibration"] = lambda s, d: V.runs(s, d).select(
    "seq", r4(G.noise_multiplier(F.col("epsilon"))).alias("multiplier"), r4(G.weight_noise(F.col("epsilon"))).alias("weight_noise"),
    r4(G.noise_scale(F.lit(0.0), F.col("n_cols").cast("double"), F.col("epsilon"), F.lit(10.0))).alias("scale"))
SQL["noise_calibration"] = q_runs.BASE + """ select seq, round(greatest(0.8,least(1.5,1.2/greatest(epsilon,0.1))),4) multiplier, round(least(1/(epsilon+1e-6),0.05),4) weight_noise,
 round(n_cols/(epsilon*10+1e-6),4) "scale" from runs"""

# ---- text
SENT = """sents as (select doc_id, lang, unnest(s) sentence, unnest(range(len(s))) pos from (select doc_id, lang, list_filter(list_transform(
  string_split(regexp_replace(text, '([.?!])\\s+', '\\1'||chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x)>20) s from documents where text is not null))"""
POOL_KEY = "(doc_id::varchar||'/'||pos::varchar)"
POOL = f"{SENT}, pool as (select lang, row_number() over (partition by lang order by {u_sql(POOL_KEY, 'pool')}, doc_id::varchar||'/'||pos::varchar) rn, sentence from sents)"
QUERIES["sentence_pool"] = lambda s, d: X.sentence_pool(T.load_table(s, d, "documents", spread=True), "doc_id", "text", "lang")
SQL["sentence_pool"] = f"with {POOL} select lang, rn, sentence from pool"


def gen_text(s, d):
    docs = T.load_table(s, d, "documents", spread=True)
    return X.gen_text(docs, "doc_id", "text", "lang", docs.count())


QUERIES["gen_text"] = gen_text
ALEN = "al as (select greatest(3, floor(avg(c)))::bigint k from (select d.doc_id, count(s.sentence) c from documents d left join sents s on s.doc_id=d.doc_id where d.text is not null group by 1))"
OPEN = f"replace(replace({pick_sql(X.OPENERS, 'row_id', 'opener')}, '{{0}}', (floor({u_sql('row_id', 'case')}*9000)+1000)::bigint::varchar), '{{1}}', {pick_sql(X.WRITERS, 'row_id', 'writer')})"
SQL["gen_text"] = f"""with {POOL}, {ALEN}, {base_sql('documents')}, {iv_sql('ivl', 'documents', 'lang')}, lab as (select row_id, value lang from (select row_id, {u_sql('row_id', 'lang')} u from base) join ivl on u>=lo and u<hi),
 sz as (select lang, count(*) m from pool group by 1),
 r as (select row_id, lab.lang, m, least(greatest(k+floor({u_sql('row_id', 'length')}*5)-2,3), m)::int kk, least(floor({u_sql('row_id', 'start')}*m)::bigint, m-1) st from lab join sz on sz.lang=lab.lang, al),
 sl as (select row_id, lang, m, st, unnest(range(kk)) slot from r),
 g as (select row_id, string_agg(case when slot=1 then {pick_sql(X.CONNECTORS, 'row_id', 'connector')}||': '||lower(substr(sentence,1,1))||substr(sentence,2) else sentence end, '  ' order by slot) body
  from sl join pool p on p.lang=sl.lang and p.rn=(st+slot)%m+1 group by 1)
 select r.row_id, lang, kk n_sentences, {OPEN.replace('row_id', 'r.row_id')}||' '||body as "text" from r join g on g.row_id=r.row_id"""

QUERIES["tfidf"] = lambda s, d: rounded(X.tfidf(T.load_table(s, d, "documents", spread=True), "doc_id", "text"), "weight")
SQL["tfidf"] = """with tk as (select doc_id, unnest(list_filter(string_split(trim(regexp_replace(lower(text),'[^\\p{L}\\p{N}]+',' ','g')),' '), lambda t: length(t)>=2)) term from documents),
 tf as (select doc_id, term, count(*) tf from tk group by 1,2), df as (select term, count(*) df from tf group by 1),
 w as (select doc_id, tf.term, (1+ln(tf))*(ln((1+(select count(*) from documents))/(1+df)::double)+1) w from tf join df on tf.term=df.term)
 select doc_id, term, round(w/sqrt(sum(w*w) over (partition by doc_id)),4) weight from w"""
