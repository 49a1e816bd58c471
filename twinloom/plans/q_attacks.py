"""Checked queries: privacy attacks and model-based scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinloom.functions.scalars import r6
from twinloom.operators import attacks, generate as G, linear, prepare, utility
from twinloom.plans import forest_sql as S, views as V
from twinloom.plans.linear_sql import linear_sql, text_sql
from twinloom.plans.q_compare import CAT_JSD, cdf_sql, counts_sql, rounded
from twinloom.plans.q_generate import stats_sql, numeric_sql
from twinloom.plans.q_tables import u_sql
from twinloom.sources import tables as T

QUERIES, SQL = {}, {}
COLS = ["c_nationkey", "c_acctbal"]
ALL = ["c_custkey", *COLS]


def scaled_sql(cols, view="customer_pair", fit="side='real'"):
    """Coordinates in real standard deviations as z1, z2, ..."""
    f = ", ".join(f"avg({c}) filter (where {fit}) m{i}, coalesce(nullif(stddev_pop({c}) filter (where {fit}),0),1) s{i}" for i, c in enumerate(cols))
    z = ", ".join(f"({c}-m{i})/s{i} z{i}" for i, c in enumerate(cols))
    return f"fit as (select {f} from {view}), z as (select *, {z} from {view}, fit)"


def dist_sql(d):
    return "sqrt(" + "+".join(f"(a.z{i}-b.z{i})*(a.z{i}-b.z{i})" for i in range(d)) + ")"


QUERIES["nearest_distance"] = lambda s, d: rounded(attacks.nearest_distance(V.customer_pair(s, d), "c_custkey", ALL), "distance")
SQL["nearest_distance"] = f"with {V.CUSTOMER_PAIR_SQL}, {scaled_sql(ALL)} select a.c_custkey, round(min({dist_sql(3)}),6) distance from z a, z b where a.side='real' and b.side='synth' group by 1"

QUERIES["mia"] = lambda s, d: rounded(attacks.mia(V.customer_pair(s, d), "c_custkey", ALL), "privacy_score", "attack_success", "threshold", "train_median", "holdout_median")
SPLIT = f"sp as (select *, side='real' and {u_sql('c_custkey', 'holdout')}<0.6 tr from customer_pair)"
SQL["mia"] = f"""with {V.CUSTOMER_PAIR_SQL}, {SPLIT}, {scaled_sql(ALL, 'sp', 'tr')}, ds as (select a.c_custkey, any_value(a.tr) tr, min({dist_sql(3)}) dist from z a, z b where a.side='real' and b.side='synth' group by 1),
 t as (select quantile_cont(dist,0.05) th, median(dist) hm from ds where not tr), x as (select avg((dist<th)::int) filter (where tr) atk, avg((dist<th)::int) filter (where not tr) base, median(dist) filter (where tr) tm from ds, t)
 select round(greatest(0,least(1,1-5*greatest(0,atk-base))),6) privacy_score, round(atk,6) attack_success, round(th,6) threshold, round(tm,6) train_median, round(hm,6) holdout_median from x, t"""

QUERIES["mia_fast"] = lambda s, d: rounded(attacks.mia_fast(V.customer_pair(s, d), "c_custkey", ALL).drop("part"), "ratio", "score")
SQL["mia_fast"] = SQL["mia"].split(",\n t as")[0].replace("<0.6", "<0.7") + """, x as (select median(dist) filter (where not tr)/(median(dist) filter (where tr)+1e-8) r from ds)
 select round(r,6) ratio, round(greatest(0,least(1,(r-1)/2+0.5)),6) score from x"""

QUERIES["singling_out"] = lambda s, d: rounded(attacks.singling_out(V.customer_pair(s, d), ALL), "safety_score", "singling_out_rate")
SQL["singling_out"] = f"""with {V.CUSTOMER_PAIR_SQL}, {scaled_sql(ALL)}, n as (select b.c_custkey, count(*) filter (where {dist_sql(3)}<0.5) k from z a, z b where a.side='real' and b.side='synth' group by 1),
 x as (select count(*) filter (where k=1) n1, count(*) nn from n) select round(1-n1::double/nn,6) safety_score, round(n1::double/nn,6) singling_out_rate, n1 n_singled, nn n_checked from x"""

QUERIES["leak_baseline"] = lambda s, d: rounded(attacks.leak_baseline(T.load_table(s, d, "lineitem"), "l_returnflag").withColumn("safety_if_all_known", attacks.leak_curve(F.lit(1.0), F.col("baseline"))), "baseline", "safety_if_all_known")
SQL["leak_baseline"] = """select count(*) n_classes, round(max(n)/sum(n),6) baseline, round(greatest(0,least(1,1-(1-max(n)/sum(n))/0.25)),6) safety_if_all_known from (select l_returnflag, count(*) n from lineitem group by 1)"""

QUERIES["tstr_baseline"] = lambda s, d: rounded(utility.tstr_baseline(T.load_table(s, d, "orders"), "o_orderstatus").withColumns(
    {"score_at_half": utility.lift_curve(F.lit(0.5), F.col("baseline")), "score_below": utility.lift_curve(F.lit(0.2), F.col("baseline"))}), "majority", "baseline", "score_at_half", "score_below")
SQL["tstr_baseline"] = """with x as (select count(*) k, max(n)/sum(n) mj, 0.5*(max(n)/sum(n))+0.5/count(*) b from (select o_orderstatus, count(*) n from orders group by 1))
 select k n_classes, round(mj,6) majority, round(b,6) baseline, round(case when 0.5<=b then least(0.4,0.5/(b+1e-6)*0.4) else 0.4+0.6*(0.5-b)/(1-b+1e-6) end,6) score_at_half,
 round(case when 0.2<=b then least(0.4,0.2/(b+1e-6)*0.4) else 0.4+0.6*(0.2-b)/(1-b+1e-6) end,6) score_below from x"""

CAP, TRIALS = 3.0, 5


def grid_pair(s, d):
    """All customers as the real side and, for every candidate epsilon, a synthetic side drawn from their marginals."""
    c = T.load_table(s, d, "customer").select("c_custkey", *COLS)
    n = c.count()
    out = None
    for i, eps in enumerate(attacks.epsilon_candidates(CAP, TRIALS)):
        g = G.gen_numeric(c, COLS, n, eps).select(F.lit("synth").alias("side"), F.col(G.ROW).alias("c_custkey"), *COLS)
        r = c.select(F.lit("real").alias("side"), "c_custkey", *[F.col(x).cast("double").alias(x) for x in COLS])
        both = r.unionByName(g).withColumn("part", F.lit(i).cast("long"))
        out = both if out is None else out.unionByName(both)
    return out


def epsilon_grid(s, d):
    scores = attacks.mia_fast(grid_pair(s, d), "c_custkey", COLS, part="part")
    eps = F.create_map(*[x for i, e in enumerate(attacks.epsilon_candidates(CAP, TRIALS)) for x in (F.lit(i).cast("long"), F.lit(e))])
    return scores.select(F.col("part").alias("trial"), r6(eps[F.col("part")]).alias("epsilon"), r6(F.col("ratio")).alias("ratio"), r6(F.col("score")).alias("score"))


QUERIES["epsilon_grid"] = epsilon_grid


def grid_sql():
    eps = attacks.epsilon_candidates(CAP, TRIALS)
    gens = " union all ".join(f"select {i} part, {e!r}::double eps, row_id c_custkey, 'synth' side, {', '.join(f'{numeric_sql(c, repr(e))} {c}' for c in COLS)} from base, st" for i, e in enumerate(eps))
    reals = " union all ".join(f"select {i} part, {e!r}::double eps, c_custkey, 'real' side, {', '.join(f'{c}::double {c}' for c in COLS)} from customer" for i, e in enumerate(eps))
    fits = ", ".join(f"avg({c}) filter (where tr) m{i}, coalesce(nullif(stddev_pop({c}) filter (where tr),0),1) s{i}" for i, c in enumerate(COLS))
    zs = ", ".join(f"({c}-m{i})/s{i} z{i}" for i, c in enumerate(COLS))
    return f"""with base as (select unnest(range((select count(*) from customer))) row_id), {stats_sql('customer', COLS)}, u as ({gens} union all {reals}),
 sp as (select *, side='real' and {u_sql('c_custkey', 'holdout')}<0.7 tr from u), fit as (select {fits} from sp), z as (select *, {zs} from sp, fit),
 ds as (select a.part, a.eps, a.c_custkey, any_value(a.tr) tr, min({dist_sql(2)}) dist from z a join z b on a.part=b.part and a.side='real' and b.side='synth' group by 1,2,3),
 x as (select part, eps, median(dist) filter (where not tr)/(median(dist) filter (where tr)+1e-8) r from ds group by 1,2)
 select part::bigint trial, round(eps,6) epsilon, round(r,6) ratio, round(greatest(0,least(1,(r-1)/2+0.5)),6) score from x"""


SQL["epsilon_grid"] = grid_sql()


# ---- model-based scores
ORDER_COLS = [c for c, _ in V.columns_of("orders")]
ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]


def class_sql(view_sql, view, target, numbers, order, trees, depth):
    """CTEs up to ``acc`` (a): the accuracy of a forest fitted on a view's synthetic side."""
    return f"with {view_sql}, {S.data_sql(view, target, numbers, order)}, {S.forest_sql(len(order), trees, depth)}, {S.accuracy_sql()}"


def baseline_sql(view, target):
    return f"base as (select count(*) k, max(n)/sum(n) mj, 0.5*(max(n)/sum(n))+0.5/count(*) b from (select {target}, count(*) n from {view} where side='real' group by 1))"


LIFT = "case when a<=b then least(0.4,a/(b+1e-6)*0.4) else 0.4+0.6*(a-b)/(1-b+1e-6) end"

QUERIES["tstr_classification"] = lambda s, d: rounded(utility.tstr_classification(V.orders_pair(s, d), "o_orderstatus"), "metric", "baseline", "score")
SQL["tstr_classification"] = class_sql(V.ORDERS_PAIR_SQL, "orders_pair", "o_orderstatus", ORDER_NUMBERS, [c for c in ORDER_COLS if c != "o_orderstatus"], 100, 8) + f""",
 {baseline_sql('orders_pair', 'o_orderstatus')} select 'classification' "method", round(a,6) metric, round(b,6) baseline, round({LIFT},6) score from acc, base"""

QUERIES["tstr_regression"] = lambda s, d: rounded(utility.tstr_regression(V.orders_pair(s, d), "o_totalprice", trees=100), "metric", "score")
REST = [c for c in ORDER_COLS if c != "o_totalprice"]
SQL["tstr_regression"] = f"""with {V.ORDERS_PAIR_SQL}, {S.data_sql('orders_pair', 'o_totalprice', ORDER_NUMBERS, REST, classes=False)}, {S.regression_sql(len(REST), 100, 8)}
 select 'regression' "method", round(r2,6) metric, null::double baseline, round(greatest(0,least(1,(r2+1)/2)),6) score from fit"""


def docs_pair(s, d):
    return T.load_table(s, d, "documents", spread=True).withColumn("side", V.side_of("doc_id")).select("side", "text", "lang")


QUERIES["tstr_text"] = lambda s, d: rounded(utility.tstr_text(docs_pair(s, d), "lang"), "metric", "baseline", "score")
SQL["tstr_text"] = f"""with docs_pair as (select row_number() over () row, case when doc_id % 2 = 0 then 'real' else 'synth' end side, text, lang from documents where text is not null and lang is not null),
 {text_sql('docs_pair', 'text', 'lang', 500)}, {linear_sql(linear.ROUNDS, linear.RIDGE)}, {baseline_sql('docs_pair', 'lang')}
 select 'text' "method", round(a,6) metric, round(b,6) baseline, round({LIFT},6) score from acc, base"""
QUERIES["utility"] = lambda s, d: rounded(utility.utility(V.customer_pair(s, d), "c_mktsegment"), "tstr", "wasserstein", "jsd", "utility")
FEATURES, TEXTS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]
SQL["utility"] = f"""with t as ({class_sql(V.CUSTOMER_PAIR_SQL, 'customer_pair', 'c_mktsegment', ALL, FEATURES, 100, 8)}, {baseline_sql('customer_pair', 'c_mktsegment')} select {LIFT} t from acc, base),
 w as ({cdf_sql(V.CUSTOMER_PAIR_SQL, 'customer_pair', ALL)} select avg(greatest(0,least(1,1-0.5*w1/(p99-p01)))) w from dist d join pct p on d."column"=p."column"
  where n_r>=2 and n_s>=2 and p99-p01>=1e-6 and not (d."column" in ('c_custkey','c_nationkey') and distinct_r > 0.9*n_r)),
 j as ({counts_sql(V.CUSTOMER_PAIR_SQL, 'customer_pair', TEXTS)}{CAT_JSD} select avg(1-distance) j from jsd)
 select round(t,6) tstr, round(w,6) wasserstein, round(j,6) jsd, round(0.5*t+0.3*w+0.2*j,6) utility from t, w, j"""

QUERIES["attribute_leak"] = lambda s, d: rounded(utility.attribute_leak(V.orders_pair(s, d), "o_orderpriority"), "safety_score", "advantage", "accuracy", "baseline")
SQL["attribute_leak"] = class_sql(V.ORDERS_PAIR_SQL, "orders_pair", "o_orderpriority", ORDER_NUMBERS, ORDER_NUMBERS, 50, 5) + f""", {baseline_sql('orders_pair', 'o_orderpriority')}
 select round(greatest(0,least(1,1-greatest(a-mj,0)/0.25)),6) safety_score, round(greatest(a-mj,0),6) advantage, round(a,6) accuracy, round(mj,6) baseline from acc, base"""

QUERIES["tstr_fast"] = lambda s, d: rounded(utility.tstr_fast(V.orders_pair(s, d), "o_orderstatus"), "accuracy", "score")
SQL["tstr_fast"] = class_sql(V.ORDERS_PAIR_SQL, "orders_pair", "o_orderstatus", ORDER_NUMBERS, ORDER_NUMBERS, 20, 4) + f""", {baseline_sql('orders_pair', 'o_orderstatus')}
 select round(a,6) accuracy, round(case when a>mj then (a-mj)/(1-mj+1e-6) else 0 end,6) score from acc, base"""

QUERIES["privacy"] = lambda s, d: rounded(utility.privacy(V.customer_pair(s, d), "c_custkey", "c_mktsegment", ALL), "mia", "singling", "leak", "privacy")
LEAK = class_sql(V.CUSTOMER_PAIR_SQL, "customer_pair", "c_mktsegment", ALL, ALL, 50, 5) + f", {baseline_sql('customer_pair', 'c_mktsegment')} select greatest(0,least(1,1-greatest(a-mj,0)/0.25)) l from acc, base"
SQL["privacy"] = f"""with m as ({SQL['mia'].replace(',6)', ',15)')}), s as ({SQL['singling_out'].replace(',6)', ',15)')}), l as ({LEAK})
 select round(m.privacy_score,6) mia, round(s.safety_score,6) singling, round(l,6) leak, round((m.privacy_score+s.safety_score+l)/3,6) privacy from m, s, l"""


def epsilon_sweep(s, d):
    from twinloom.plans.release import sweep

    real = T.load_table(s, d, "customer").drop("c_name")
    return sweep(real, "c_custkey", "c_mktsegment", COLS, CAP, TRIALS)


QUERIES["epsilon_sweep"] = epsilon_sweep


def release_report(s, d):
    from twinloom.plans.release import report

    return report(s, d)


QUERIES["release_report"] = release_report
