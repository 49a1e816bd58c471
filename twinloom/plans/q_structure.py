"""Checked queries: temporal and causal fidelity."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinloom.operators import causal, compare, temporal
from twinloom.plans import views as V
from twinloom.plans.q_compare import corr_sql, rounded

QUERIES, SQL = {}, {}

EDGES = f"""ed as (select list_sort(list_distinct(quantile_cont("value", [{','.join(str(i / 10) for i in range(11))}]))) e, median("value") md from events_pair where side='real'),
 stt as (select side, event_id, ts, len(list_filter(e[2:len(e)-1], lambda x: x <= coalesce("value", md)))::int state from events_pair, ed),
 mv as (select side, state, lead(state) over (partition by side order by ts) nxt from stt),
 k as (select len(e)-1 k from ed),
 cells as (select unnest(range(k*k))//k state, unnest(range(k*k))%k nxt from k),
 ct as (select c.state, c.nxt, count(m.side) filter (where side='real') r, count(m.side) filter (where side='synth') s from cells c left join mv m on m.state=c.state and m.nxt=c.nxt group by 1,2),
 tr as (select state::int state, nxt::int next_state, r, s, (r+1)/(sum(r) over (partition by state)+k)::double p from ct, k)"""
QUERIES["markov_transitions"] = lambda s, d: rounded(temporal.transitions(V.events_pair(s, d), "value", "ts"), "p")
SQL["markov_transitions"] = f"with {V.EVENTS_PAIR_SQL}, {EDGES} select state, next_state, r, s, round(p,6) p from tr"

QUERIES["markov_score"] = lambda s, d: rounded(temporal.markov_score(V.events_pair(s, d), "value", "ts"), "real_ll", "synth_ll", "score")
SQL["markov_score"] = f"""with {V.EVENTS_PAIR_SQL}, {EDGES}, l as (select sum(r*ln(p+1e-12))/sum(r) rl, sum(s*ln(p+1e-12))/sum(s) sl, max(state)+1 n from tr)
 select 'markov' "method", round(rl,6) real_ll, round(sl,6) synth_ll, n n_states, round(greatest(0,least(1,1-abs(1-sl/rl))),6) score from l"""

QUERIES["markov_by_entity"] = lambda s, d: rounded(temporal.transitions(V.events_pair(s, d), "value", "ts", ["user_id"]), "p")
SQL["markov_by_entity"] = f"with {V.EVENTS_PAIR_SQL}, {EDGES.replace('select side, event_id, ts', 'select side, user_id, ts').replace('partition by side', 'partition by side, user_id')} select state, next_state, r, s, round(p,6) p from tr"

# by day: orders of one day follow their key
DAILY = f"with {V.ORDERS_PAIR_SQL}"
QUERIES["markov_by_day"] = lambda s, d: rounded(temporal.transitions(V.orders_pair(s, d), "o_totalprice", "o_orderdate", tie="o_orderkey"), "p")
SQL["markov_by_day"] = DAILY + ", " + EDGES.replace("events_pair", "orders_pair").replace('"value"', "o_totalprice").replace("select side, event_id, ts", "select side, o_orderkey, o_orderdate").replace(
    "order by ts", "order by o_orderdate, o_orderkey") + " select state, next_state, r, s, round(p,6) p from tr"
QUERIES["autocorr_by_day"] = lambda s, d: rounded(temporal.autocorr(V.orders_pair(s, d), "o_orderdate", ["o_totalprice", "o_custkey"], tie="o_orderkey"), "ac_real", "ac_synth", "score")
SQL["autocorr_by_day"] = DAILY + """, long as (select side, o_orderdate, o_orderkey, unnest([{'c':'o_totalprice','v':o_totalprice},{'c':'o_custkey','v':o_custkey::double}]) x from orders_pair),
 lg as (select x.c "column", side, x.v v, lead(x.v) over (partition by x.c, side order by o_orderdate, o_orderkey) nv from long), a as (select "column", corr(v,nv) filter (where side='real') r, corr(v,nv) filter (where side='synth') s from lg group by 1)
 select "column", round(r,6) ac_real, round(s,6) ac_synth, round(1-least(1,abs(r-s)),6) score from a"""


def gappy(s, d):
    """Events with a tenth of the values missing."""
    e = V.events_pair(s, d)
    return e.withColumn("value", F.when(F.col("event_id") % 10 != 3, F.col("value")))


QUERIES["autocorr"] = lambda s, d: rounded(temporal.autocorr(gappy(s, d), "ts", ["value", "user_id"]), "ac_real", "ac_synth", "score")
SQL["autocorr"] = f"""with {V.EVENTS_PAIR_SQL}, long as (select side, ts, 'value' "column", "value" v from events_pair where event_id%10<>3 union all select side, ts, 'user_id', user_id::double from events_pair),
 lg as (select *, lead(v) over (partition by "column", side order by ts) nv from long), a as (select "column", corr(v,nv) filter (where side='real') r, corr(v,nv) filter (where side='synth') s from lg group by 1)
 select "column", round(r,6) ac_real, round(s,6) ac_synth, round(1-least(1,abs(r-s)),6) score from a"""

# totals depend on prices and quantities, so there are edges to find
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "charge", "paid"]
PAIR = V.LINEITEM_PAIR_SQL + """, cp as (select *, l_extendedprice*(1-l_discount) charge, l_extendedprice*(1-l_discount)*(1+l_tax)+1000*l_quantity paid from lineitem_pair)"""


def charged(s, d):
    p = V.lineitem_pair(s, d)
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return p.withColumns({"charge": charge, "paid": charge * (1 + F.col("l_tax")) + 1000 * F.col("l_quantity")})


QUERIES["causal_corr"] = lambda s, d: rounded(causal.correlation_fidelity(charged(s, d), None, NUM), "score", "edge_overlap")
SQL["causal_corr"] = f"""with {PAIR}, {corr_sql('cp', NUM)}, j as (select r.rho r, s.rho s from corr_r r join corr_s s on r.a=s.a and r.b=s.b),
 o as (select greatest(0,least(1,1-avg(abs(r-s)))) base, greatest(0,count(*) filter (where abs(r)>0.15)-6) nr, greatest(0,count(*) filter (where abs(s)>0.15)-6) ns, greatest(0,count(*) filter (where abs(r)>0.15 and abs(s)>0.15)-6) tp from j)
 select round(case when ns=0 and nr>0 then greatest(0.4,least(0.7,0.8*base)) else base end,6) score, nr n_edges_real, ns n_edges_synth,
 round(case when ns=0 and nr>0 then 0.0 else tp::double/greatest(nr,1) end,6) edge_overlap from o"""


def partial_sql(xy, xz, yz):
    return f"coalesce(({xy}-{xz}*{yz})/nullif(sqrt(greatest(0,(1-{xz}*{xz})*(1-{yz}*{yz}))),0),0)"


def indep_sql(rho, order):
    safe = f"least(greatest({rho},-1+1e-12),1-1e-12)"
    return f"0.5*abs(ln((1+{safe})/(1-{safe})))*sqrt(greatest(n-{order}-3,1)) <= {causal.NORMAL_975}"


def partials_sql(order):
    """p{order}: partial correlations given ``order`` columns, ascending in s, by the recursion over the last one."""
    before = f"p{order - 1}"
    seen = "[]" if order == 1 else "x.s"
    return f"""p{order} as (select x.side, x.a, x.b, list_append({seen}, y.b) s, x.n, {partial_sql('x.p', 'y.p', 'z.p')} p from {before} x join {before} y on y.side=x.side and y.a=x.a and y.s=x.s
   join {before} z on z.side=x.side and z.a=x.b and z.b=y.b and z.s=x.s where x.a<>x.b and y.b<>x.a and y.b<>x.b and (len(x.s)=0 or y.b>x.s[-1]))"""


def level_sql(order):
    """e{order}: the edges left when sets of ``order`` neighbours at most have been tested."""
    near = "list_filter(q.s, lambda v: not list_contains(k.l, v))"
    return f"""n{order - 1} as (select side, a, list(b) l from (select side, a, b from e{order - 1} union select side, b, a from e{order - 1}) group by 1,2),
 e{order} as (select side, a, b from e{order - 1} except select q.side, q.a, q.b from p{order} q join n{order - 1} k on k.side=q.side and (k.a=q.a or k.a=q.b) where q.a<q.b and len({near})=0 and {indep_sql('q.p', order).replace('(n-', '(q.n-')})"""


SKEL = f"""with {PAIR}, {corr_sql('cp', NUM)}, nn as (select side, count(*) n from cp group by 1),
 p0 as (select 'real' side, a, b, []::varchar[] s, n, rho p from corr_r, nn where side='real' union all select 'synth', a, b, []::varchar[], n, rho from corr_s, nn where side='synth'),
 e0 as (select side, a, b from p0 where a<b and not ({indep_sql('p', 0)})), {', '.join(f'{partials_sql(k)}, {level_sql(k)}' for k in range(1, len(NUM) - 1))},
 sk as (select side, a, b from e{len(NUM) - 2})"""
QUERIES["causal_skeleton"] = lambda s, d: causal.causal_skeleton(charged(s, d), None, NUM)
SQL["causal_skeleton"] = SKEL + " select side, a, b from sk"
QUERIES["edge_f1"] = lambda s, d: rounded(causal.edge_f1(causal.causal_skeleton(charged(s, d), None, NUM)), "overlap", "precision", "score")
SQL["edge_f1"] = SKEL + """, e as (select a, b, bool_or(side='real') r, bool_or(side='synth') s from sk group by 1,2),
 c as (select count(*) filter (where r) nr, count(*) filter (where s) ns, count(*) filter (where r and s) tp from e)
 select nr n_real, ns n_synth, round(tp::double/nr,6) overlap, round(tp::double/greatest(ns,1),6) "precision", round(2*(tp::double/nr)*(tp::double/ns)/((tp::double/nr)+(tp::double/ns)),6) score from c"""
