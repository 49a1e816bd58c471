"""Checked queries: distribution fidelity."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinloom.functions.scalars import r6
from twinloom.operators import compare
from twinloom.plans import views as V

QUERIES, SQL = {}, {}
NUM = V.LINE_NUMERIC


def rounded(df, *cols):
    return df.select(*[r6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def unpivot_sql(view, cols, keep="side"):
    parts = [f"select {keep}, '{c}' as \"column\", {c}::double v from {view} where {c} is not null" for c in cols]
    return "(" + " union all ".join(parts) + ")"


def cats_sql(view, cols):
    parts = [f"select side, '{c}' as \"column\", {c}::varchar v from {view} where {c} is not null" for c in cols]
    return "(" + " union all ".join(parts) + ")"


def cdf_sql(view_sql, view, cols):
    return f"""with {view_sql},
 long as {unpivot_sql(view, cols)},
 g as (select "column", v, count(*) filter (where side='real') r, count(*) filter (where side='synth') s from long group by all),
 c as (select "column", v, r, s,
   sum(r) over (partition by "column" order by v rows unbounded preceding)::double / sum(r) over (partition by "column") fr,
   sum(s) over (partition by "column" order by v rows unbounded preceding)::double / sum(s) over (partition by "column") fs,
   lead(v) over (partition by "column" order by v) nv from g),
 dist as (select "column", max(abs(fr-fs)) ks, coalesce(sum(abs(fr-fs)*(nv-v)),0) w1, min(v) filter (where r>0) lo, max(v) filter (where r>0) hi,
   sum(r) n_r, sum(s) n_s, count(*) filter (where r>0) distinct_r from c group by 1),
 pct as (select "column", quantile_cont(v, 0.01) p01, quantile_cont(v, 0.99) p99 from long where side='real' group by 1)"""


LINE_CDF = cdf_sql(V.LINEITEM_PAIR_SQL, "lineitem_pair", NUM)

QUERIES["ks"] = lambda s, d: rounded(compare.ks(V.lineitem_pair(s, d), NUM), "ks", "score")
SQL["ks"] = LINE_CDF + """ select "column", round(ks,6) ks, round(1-ks,6) score from dist where n_r>=2 and n_s>=2"""

QUERIES["wasserstein"] = lambda s, d: rounded(compare.wasserstein(V.lineitem_pair(s, d), NUM), "w1", "spread", "score")
SQL["wasserstein"] = LINE_CDF + """ select d."column", round(w1,6) w1, round(p99-p01,6) spread,
 round(greatest(0,least(1,1-0.5*w1/(p99-p01))),6) score from dist d join pct p on d."column"=p."column"
 where n_r>=2 and n_s>=2 and p99-p01>=1e-6
 and not (d."column" in ('l_orderkey','l_partkey','l_suppkey','l_linenumber') and distinct_r > 0.9*n_r)"""

QUERIES["wasserstein_range"] = lambda s, d: rounded(compare.wasserstein_range(V.lineitem_pair(s, d), NUM), "w1", "value_range", "score")
SQL["wasserstein_range"] = LINE_CDF + """ select "column", round(w1,6) w1, round(greatest(hi-lo,1e-6),6) value_range,
 round(greatest(0,least(1,1-w1/greatest(hi-lo,1e-6))),6) score from dist"""


def binned_sql(view_sql, view, cols, bins):
    return f"""with {view_sql}, long as {unpivot_sql(view, cols)},
 lim as (select "column", case when min(v)=max(v) then min(v)-0.5 else min(v) end lo,
   (case when min(v)=max(v) then 1.0 else max(v)-min(v) end)/{bins} width from long group by 1),
 b as (select l."column", least(floor((v-lo)/width),{bins - 1})::int bin, any_value(lo) lo, any_value(width) width,
   count(*) filter (where side='real') r, count(*) filter (where side='synth') s
   from long l join lim on l."column"=lim."column" group by 1,2)"""


JSD_BINNED = binned_sql(V.LINEITEM_PAIR_SQL, "lineitem_pair", NUM, 20) + """,
 tot as (select "column", sum(r) n_r, sum(s) n_s from b group by 1),
 cells as (select "column", n_r, n_s, unnest(range(20))::int bin from tot),
 pq as (select c."column", (coalesce(r,0)/n_r+1e-10)/(1+20*1e-10) p, (coalesce(s,0)/n_s+1e-10)/(1+20*1e-10) q
   from cells c left join b on c."column"=b."column" and c.bin=b.bin),
 jsd as (select "column", sqrt(greatest(0,sum((p*ln(p/((p+q)/2))+q*ln(q/((p+q)/2)))/2))) distance from pq group by 1)"""
QUERIES["jsd_binned"] = lambda s, d: rounded(compare.jsd_binned(V.lineitem_pair(s, d), NUM), "distance", "score")
SQL["jsd_binned"] = JSD_BINNED + """ select "column", round(distance,6) distance, round(greatest(0,least(1,1-distance)),6) score from jsd"""

QUERIES["histogram_compare"] = lambda s, d: rounded(compare.histogram_compare(V.lineitem_pair(s, d), NUM[4:]), "bin_start")
SQL["histogram_compare"] = binned_sql(V.LINEITEM_PAIR_SQL, "lineitem_pair", NUM[4:8], 25) + """ select "column", bin, round(lo+bin*width,6) bin_start, r, s from b"""

CATS = ["l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def counts_sql(view_sql, view, cols):
    return f"""with {view_sql}, long as {cats_sql(view, cols)},
 g as (select "column", v, count(*) filter (where side='real') r, count(*) filter (where side='synth') s from long group by all)"""


CAT_JSD = """, tot as (select "column", sum(r) n_r, sum(s) n_s, count(*) k from g group by 1),
 pq as (select g."column", (r/n_r+1e-8)/(1+k*1e-8) p, (s/n_s+1e-8)/(1+k*1e-8) q from g join tot on g."column"=tot."column"),
 jsd as (select "column", sqrt(greatest(0,sum((p*ln(p/((p+q)/2))+q*ln(q/((p+q)/2)))/2))) distance from pq group by 1)"""
QUERIES["jsd_categorical"] = lambda s, d: rounded(compare.jsd_categorical(V.lineitem_pair(s, d)), "distance", "score")
NARROW_SQL = """, few as (select "column" from long group by 1 having "column" in ('l_returnflag','l_linestatus') or count(distinct v) filter (where side='real') <= 20),
 g as (select "column", v, count(*) filter (where side='real') r, count(*) filter (where side='synth') s from long where "column" in (from few) group by all)"""
SQL["jsd_categorical"] = f"with {V.LINEITEM_PAIR_SQL}, long as {cats_sql('lineitem_pair', [c for c, _ in V.columns_of('lineitem')])}" + NARROW_SQL + CAT_JSD + """
 select "column", round(distance,6) distance, round(1-distance,6) score from jsd"""

CHI = """, gg as (select "column", r+1 r, s+1 s from g), tot2 as (select "column", sum(r) n_r, sum(s) n_s, count(*) k from gg group by 1),
 chi as (select gg."column", sum((s*(n_r/n_s)-r)*(s*(n_r/n_s)-r)/r) stat, max(k) k from gg join tot2 on gg."column"=tot2."column" group by 1)"""
TEXTS = ["l_returnflag", "l_linestatus"]
QUERIES["chi_square"] = lambda s, d: rounded(compare.chi_square(V.lineitem_pair(s, d)), "stat", "score")
SQL["chi_square"] = counts_sql(V.LINEITEM_PAIR_SQL, "lineitem_pair", TEXTS) + CHI + """
 select "column", round(stat,6) stat, k, round(1/(1+stat/k),6) score from chi"""


def corr_sql(view, cols, names=("corr_r", "corr_s")):
    out = []
    for name, side in zip(names, ("real", "synth")):
        cells = " union all ".join(
            f"select '{a}' a, '{b}' b, coalesce(case when isnan(corr({a},{b})) then 0 else corr({a},{b}) end,0) rho from {view} where side='{side}'"
            for a in cols for b in cols
        )
        out.append(f"{name} as ({cells})")
    return ", ".join(out)


CORR = "with " + V.LINEITEM_PAIR_SQL + ", " + corr_sql("lineitem_pair", NUM)
QUERIES["corr_similarity"] = lambda s, d: rounded(compare.corr_similarity(V.lineitem_pair(s, d), NUM), "mean_diff", "score")
SQL["corr_similarity"] = CORR + """ select round(avg(abs(r.rho-s.rho)),6) mean_diff, round(1-least(1,avg(abs(r.rho-s.rho))),6) score
 from corr_r r join corr_s s on r.a=s.a and r.b=s.b"""

QUERIES["realism"] = lambda s, d: rounded(compare.realism(V.lineitem_pair(s, d)), "realism")
SQL["realism"] = LINE_CDF + ", " + f"longc as {cats_sql('lineitem_pair', TEXTS)}," + """
 gc as (select "column", v, count(*) filter (where side='real') r, count(*) filter (where side='synth') s from longc group by all)""" + \
    CHI.replace("from g)", "from gc)") + ", " + corr_sql("lineitem_pair", NUM) + """
 select round(avg(part),6) realism from (select avg(1-ks) part from dist union all select avg(1/(1+stat/k)) from chi
 union all select 1-least(1,avg(abs(r.rho-s.rho))) from corr_r r join corr_s s on r.a=s.a and r.b=s.b)"""

QUERIES["distributional"] = lambda s, d: rounded(
    compare.distributional(V.lineitem_pair(s, d), NUM), "wasserstein_score", "jsd_score", "distributional")
SQL["distributional"] = LINE_CDF + ", " + JSD_BINNED[JSD_BINNED.index("lim as"):] + """
 select round(w,6) wasserstein_score, round(j,6) jsd_score, round(0.5*w+0.5*j,6) distributional from
 (select (select avg(greatest(0,least(1,1-w1/greatest(hi-lo,1e-6)))) from dist) w, (select avg(greatest(0,least(1,1-distance))) from jsd) j)"""
