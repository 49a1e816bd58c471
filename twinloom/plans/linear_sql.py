"""The text classifier of ``operators/utility.py`` and ``operators/linear.py`` as SQL, step by step."""

from __future__ import annotations


def text_sql(view: str, text: str, label: str, size: int, min_df: int = 2) -> str:
    """CTEs after a view (row, side, text, label): ``lab`` (row, side, y) and ``x`` (row, j, v), the intercept as feature 0."""
    return f"""lab as materialized (select row, side, dense_rank() over (order by {label}) - 1 y from {view}),
 tk as (select row, list_filter(string_split(trim(regexp_replace(lower({text}),'[^\\p{{L}}\\p{{N}}]+',' ','g')),' '), lambda t: length(t)>=2) w from {view}),
 tf as materialized (select row, term, count(*) tf from (select row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i]||' '||w[i+1]))) term from tk) group by 1, 2),
 vocab as materialized (select term, df, row_number() over (order by total desc, term) j from (select term, sum(tf) total, count(*) df from tf group by 1 having count(*)>={min_df} order by total desc, term limit {size})),
 wt as (select row, j, (1+ln(tf))*(ln((1+(select count(*) from {view}))/(1+df)::double)+1) w from tf join vocab using (term)),
 x as materialized (select row, j, w/sqrt(sum(w*w) over (partition by row)) v from wt union all select row, 0, 1 from {view})"""


def linear_sql(rounds: int, ridge: float) -> str:
    """CTEs after ``lab`` and ``x``: the weights after the last round, and ``acc`` (a) on the real rows."""
    penalty = f"(case when j=0 then 0 else {ridge} end)"
    out = [
        "xs as materialized (select row, j, v, y from x join lab using (row) where side='synth')",
        f"curve as materialized (select j, 0.5*sum(v*s) + {penalty} d from xs join (select row, sum(v) s from xs group by 1) using (row) group by j)",
        "w0 as materialized (select c, j, d, 0::double now, 0::double past from curve, (select distinct y c from lab))",
    ]
    for t in range(rounds):
        out.append(f"a{t} as materialized (select c, j, d, now, now + {t}/{t + 3}::double*(now-past) here from w{t})")
        out.append(f"z{t} as (select row, c, (c=any_value(y))::int is_y, sum(v*here) z from xs join a{t} using (j) group by row, c)")
        out.append(f"e{t} as (select row, c, is_y, exp(z - max(z) over (partition by row)) e from z{t})")
        out.append(f"r{t} as materialized (select row, c, e/sum(e) over (partition by row) - is_y r from e{t})")
        out.append(f"g{t} as (select c, j, sum(r*v) g from xs join r{t} using (row) group by c, j)")
        out.append(f"w{t + 1} as materialized (select c, j, d, here - (g + {penalty}*here)/d now, now past from a{t} join g{t} using (c, j))")
    out.append(f"told as (select row, arg_max(c, (z, -c)) c from (select row, c, sum(v*now) z from x join w{rounds} using (j) group by row, c) group by row)")
    out.append("acc as (select avg((lab.y=told.c)::int) a from lab join told using (row) where side='real')")
    return ",\n ".join(out)
