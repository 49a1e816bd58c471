"""The forests of ``operators/trees.py`` as SQL, level by level."""

from __future__ import annotations

import math

from twinloom.operators import trees as T


def data_sql(view: str, target: str, numbers: list[str], order: list[str], classes: bool = True) -> str:
    """``data`` (rid, side, y or label, f0, f1, ...) of a view's rows; texts and classes as codes of their joint sorted order."""
    code = lambda c: f"(dense_rank() over (order by {c}::varchar) - 1)"
    feats = ", ".join((f"coalesce({c}::double, 0)" if c in numbers else f"{code(c)}::double") + f" f{i}" for i, c in enumerate(order))
    y = f"{code(target)}::bigint y" if classes else f"{target}::double label"
    return f"data as materialized (select row_number() over () rid, side, {y}, {feats} from {view})"


def forest_sql(n_cols: int, trees: int, depth: int, numeric: bool = False, seed: int = 42, bins: int = T.BINS) -> str:
    """CTEs after ``data`` (rid, side, y, f0, ...) that end in ``told`` (rid, prediction)."""
    cols = range(n_cols)
    k = n_cols if numeric or trees == 1 else math.isqrt(n_cols - 1) + 1
    names = ", ".join(f"b{i}" for i in cols)
    out = [
        f"e{i} as materialized (select coalesce(list(v order by v), []) e from (select v, s, sum(s) over (order by v) upto, sum(s) over () n from"
        f" (select f{i} v, count(*) s from data where side='synth' group by 1)) where upto*{bins}//n > (upto-s)*{bins}//n and upto < n)" for i in cols
    ]
    out.append(f"binned as materialized (select rid, side, y, {', '.join(f'len(list_filter(e{i}.e, lambda x: x < f{i}))::bigint b{i}' for i in cols)} from data, {', '.join(f'e{i}' for i in cols)})")
    out.append(f"cells as (select {names}, y, count(*) n, ('0x'||substr(md5(concat_ws(',', {names}, y)),1,8))::bigint % {T.PRIME} h from binned where side='synth' group by all)")
    mixed = ", ".join(f"({t}, {a}, {b})" for t, (a, b) in enumerate(T.mixers(trees, seed)))
    out.append(f"trees(t, a, b) as (values {mixed})")
    table = ", ".join(str(x) for x in T.TABLE)
    out.append(f"drawn as (select t, {names}, y, n, (h*a+b) % {T.PRIME} u, floor(sqrt(3.0*n))::bigint r from cells, trees)")
    out.append(
        f"rows0 as materialized (select * from (select t, 1::bigint node, {names}, y, case when n > {T.EXACT} then n - r + (2*u*r+{T.PRIME // 2})//{T.PRIME}"
        f" else len(list_filter(([{table}])[n], lambda x: x <= u))::bigint end w from drawn) where w > 0)")
    out.append(f"walk0 as (select rid, t, 1::bigint node, {names} from binned, trees where side='real')")
    for d in range(depth):
        offer = f"select t, node, f, row_number() over (partition by t, node order by md5('{seed}:'||t||':'||node||':'||f)) rk from (select distinct t, node from rows{d}), (select unnest(range({n_cols})) f)"
        long = " union all ".join(f"select t, node, {i} f, b{i} b, y, w from rows{d}" for i in cols)
        out.append(f"hist{d} as materialized (select t, node, f, b, {'0' if numeric else 'y'} y, sum(w)::bigint w, sum(w*y)::bigint s from ({long}) join (select t, node, f from ({offer}) where rk <= {k}) using (t, node, f) group by all)")
        # running sums at every used bin for every label of the node
        out.append(f"""run{d} as (select g.t, g.node, g.f, g.b, g.y, sum(coalesce(w,0)) over (p order by g.b)::double lw, sum(coalesce(s,0)) over (p order by g.b)::double ls,
 sum(coalesce(w,0)) over p::double tw, sum(coalesce(s,0)) over p::double ts
 from (select * from (select distinct t, node, f, b from hist{d}) join (select distinct t, node, f, y from hist{d}) using (t, node, f)) g left join hist{d} using (t, node, f, b, y)
 window p as (partition by g.t, g.node, g.f, g.y))""")
        top = ("ls", "ts") if numeric else ("lw", "tw")
        side = lambda x: f"sum({x}*{x})" if not numeric else f"(sum({x})*sum({x}))"
        l, a = top
        out.append(f"""cut{d} as materialized (select t, node, f, b from (select *, row_number() over (partition by t, node order by score desc, f, b) rk from
 (select t, node, f, b, {side(l)}/sum(lw) + {side(f'({a}-{l})')}/greatest(sum(tw-lw),1) score, {side(a)}/sum(tw) own from run{d} group by all having sum(tw-lw) > 0) where score > own) where rk = 1)""")
        at = "case f " + " ".join(f"when {i} then b{i}" for i in cols) + " end"
        out.append(f"rows{d + 1} as materialized (select r.t, 2*r.node + ({at} > c.b)::bigint node, {names}, y, w from rows{d} r join cut{d} c on r.t=c.t and r.node=c.node)")
        out.append(f"walk{d + 1} as (select rid, r.t, coalesce(2*r.node + ({at} > c.b)::bigint, r.node) node, {names} from walk{d} r left join cut{d} c on r.t=c.t and r.node=c.node)")
    every = " union all ".join(f"select t, node, y, w from rows{d}" for d in range(depth + 1))
    if numeric:
        out.append(f"held as materialized (select t, node, sum(w*y)/sum(w)::double m from ({every}) group by all)")
        out.append(f"told as (select rid, avg(m) prediction from walk{depth} join held using (t, node) group by 1)")
    else:
        out.append(f"held as materialized (select t, node, y, sum(w)*{T.STEPS}//sum(sum(w)) over (partition by t, node) share from ({every}) group by t, node, y)")
        out.append(f"told as (select rid, arg_max(y, (votes, -y)) prediction from (select rid, y, sum(share) votes from walk{depth} join held using (t, node) group by 1, 2) group by 1)")
    return ",\n ".join(out)


def accuracy_sql() -> str:
    """After ``told``: ``acc`` (a)."""
    return "acc as (select avg((d.y = t.prediction)::int) a from data d join told t using (rid) where d.side='real')"


def regression_sql(n_cols: int, trees: int, depth: int) -> str:
    """After ``data`` with a ``label``: ``told``, and ``fit`` (r2)."""
    steps = float(T.STEPS)
    scaled = f"lim as (select min(label) lo, max(label)-min(label) spread from data where side='synth'), stepped as materialized (select data.* exclude (label), floor((label-lo)/spread*{steps})::bigint y from data, lim)"
    forest = forest_sql(n_cols, trees, depth, numeric=True).replace("from data", "from stepped")
    return f"""{scaled}, {forest},
 fit as (select 1 - sum((label-(lo+(prediction+0.5)/{steps}*spread))**2)/(var_pop(label)*count(*)) r2 from data join told using (rid), lim where side='real')"""
