"""Checked queries: sources, roles, profiles and preparation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinloom.functions import fixed, pairs, rng
from twinloom.functions.scalars import r6
from twinloom.operators import ledger, prepare, profile, roles
from twinloom.plans import views as V
from twinloom.plans.q_compare import rounded
from twinloom.session import checkpoint_dir
from twinloom.sources import registry, tables as T

QUERIES, SQL = {}, {}


def u_sql(key, tag, seed=42, slot=0):
    return f"(('0x'||substr(md5({key}::varchar||':{tag}:{seed}'),{1 + 13 * slot},13))::UBIGINT/4503599627370496.0)"


def normal_sql(key, tag, seed=42):
    return f"(sqrt(-2.0*ln(1.0-{u_sql(key, tag, seed)}))*cos({2 * 3.141592653589793!r}*{u_sql(key, tag, seed, 1)}))"


def laplace_sql(key, tag, scale, seed=42):
    h = f"({u_sql(key, tag, seed)}-0.5)"
    return f"(-({scale})*sign({h})*ln(greatest(1.0-2.0*abs({h}),1e-300)))"


def load(t):
    return lambda s, d: T.load_table(s, d, t)


# ---- sources
def scan_rows(s, d):
    out = None
    for t, df in V.all_tables(s, d).items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("dataset"), "n_rows")
        out = one if out is None else out.unionAll(one)
    return out


QUERIES["scan_rows"] = scan_rows
SQL["scan_rows"] = " union all ".join(f"select '{t}' dataset, count(*) n_rows from {t}" for t in V.TABLES)


def registry_query(s, d):
    reg = registry.Registry(V.contracts())
    rows = scan_rows(s, d)
    there = reg.available(s, rows).select("name", "target", "modality", F.lit(True).alias("available"))
    gone = reg.missing(s, rows).select("name", "target", "modality", F.lit(False).alias("available"))
    return there.unionAll(gone).join(rows.withColumnRenamed("dataset", "name"), "name", "left")


QUERIES["registry"] = registry_query
SQL["registry"] = f"with {V.contracts_sql()}, n as ({SQL['scan_rows']}) select c.dataset as \"name\", target, modality, n.dataset is not null available, n_rows from contracts c left join n on c.dataset=n.dataset"

QUERIES["demo_metadata"] = lambda s, d: registry.demo_metadata(T.load_table(s, d, "orders"), "o_orderkey")


def pick_sql(options, key, tag):
    return f"([{', '.join(repr(o) for o in options)}])[floor({u_sql(key, tag)}*{len(options)})::int+1]"


SQL["demo_metadata"] = f"""select patient_id, label, finding, gender, age, 'images/'||replace(lower(label),' ','_')||'_'||substr(patient_id,2)||'.png' image_path from (
 select 'P'||printf('%04d',o_orderkey) patient_id, {pick_sql(fixed.DEMO_LABELS, 'o_orderkey', 'label')} label, {pick_sql(fixed.DEMO_FINDINGS, 'o_orderkey', 'finding')} finding,
 {pick_sql(fixed.DEMO_GENDERS, 'o_orderkey', 'gender')} gender, (floor({u_sql('o_orderkey', 'age')}*68)+18)::int age from orders)"""


def csv_roundtrip(s, d):
    """Write customers as CSV part files to the shared folder, read them back by schema, compare digests."""
    c = T.load_table(s, d, "customer")
    path = f"{checkpoint_dir(s)}/csv-{uuid.uuid4().hex}"
    T.write_csv(c, path)
    back = T.read_csv(s, path, c.schema)
    a, b = T.table_digest(c).select(F.lit("written").alias("copy"), "*"), T.table_digest(back).select(F.lit("read").alias("copy"), "*")
    return a.unionAll(b)


QUERIES["csv_roundtrip"] = csv_roundtrip
DIGEST_CELLS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "epoch_us(o_orderdate)", "o_orderpriority"],
}
DIGEST_ROW = {t: " || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '-')" for c in cells) for t, cells in DIGEST_CELLS.items()}


def digest_sql(t, alias=""):
    words = ", ".join(f"sum(('0x'||substr(h,{1 + 15 * i},15))::UBIGINT::hugeint) w{i}" for i in range(4))
    return f"""select {alias} n n_rows, sha256(concat_ws(':', n::varchar, w0::varchar, w1::varchar, w2::varchar, w3::varchar)) digest from
 (select count(*) n, {words} from (select sha256({DIGEST_ROW[t]}) h from {t}))"""


SQL["csv_roundtrip"] = digest_sql("customer", "'written' as \"copy\",") + " union all " + digest_sql("customer", "'read' as \"copy\",")
QUERIES["table_fingerprint"] = lambda s, d: T.table_digest(T.load_table(s, d, "orders"))
SQL["table_fingerprint"] = digest_sql("orders")

QUERIES["preview"] = lambda s, d: T.preview(T.load_table(s, d, "orders"), "o_orderkey", 20)
SQL["preview"] = "select * from orders order by o_orderkey limit 20"

QUERIES["column_info"] = lambda s, d: T.column_info(T.load_table(s, d, "lineitem")).withColumn("type", F.lower("type"))
SQL["column_info"] = " union all ".join(
    f"select {i} ordinal, '{c}' \"column\", '{t}' as \"type\", count({c}) n_nonnull, count(distinct {c}) n_distinct from lineitem"
    for i, (c, t) in enumerate(zip([c for c, _ in V.columns_of("lineitem")],
                                   ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string", "timestamp_ntz"])))


# ---- roles
def cat(s, d):
    return roles.catalogue(s, V.all_tables(s, d))


def names(s, d):
    return roles.schema_catalogue(s, V.all_tables(s, d))


def con(s):
    return roles.contracts_frame(s, V.contracts())


CAT = f"with {V.catalogue_sql()}, {V.contracts_sql()}"
QUERIES["target_present"] = lambda s, d: roles.target_present(names(s, d), con(s))
SQL["target_present"] = CAT + """ select k.dataset, k.target, coalesce(bool_or(c."column"=k.target),false) has_target, count(*) filter (where not coalesce(c."column"=k.target,false)) n_features
 from contracts k join cat c on c.dataset=k.dataset group by 1,2"""

QUERIES["discrete_columns"] = lambda s, d: roles.discrete_columns(cat(s, d), con(s))
SQL["discrete_columns"] = CAT + """ select c.dataset, ordinal, c."column" from cat c left join contracts k on c.dataset=k.dataset
 where case when k.discrete is not null then list_contains(k.discrete, c."column") else kind='string' or (kind='int' and n_distinct<=20) end"""

MODALITY = """, md0 as (select dataset, coalesce(bool_or(kind='string' and avg_len>50),false) lt, count(*) n, count(*) filter (where kind in ('int','float')) nn, min(lo) lo, max(hi) hi, sum(n_nonnull-2*off_whole) g from cat group by 1),
 md as (select m.dataset, case when k.modality in ('tabular','text','image','graph') then k.modality when lt then 'text'
   when n>200 and nn*1.0/n>0.95 and lo>=0 and hi<=255 and g>0 then 'image' else 'tabular' end modality from md0 m left join contracts k on m.dataset=k.dataset)"""
QUERIES["infer_modality"] = lambda s, d: roles.infer_modality(cat(s, d), con(s))
SQL["infer_modality"] = CAT + MODALITY + " select dataset, modality from md"

QUERIES["infer_task"] = lambda s, d: roles.infer_task(cat(s, d), con(s))
SQL["infer_task"] = CAT + MODALITY + """ select m.dataset, m.modality, case when m.modality in ('text','image') or c.n_distinct is null then 'generation' when c.n_distinct<=20 then 'classification' else 'regression' end task
 from md m left join contracts k on m.dataset=k.dataset left join cat c on c.dataset=m.dataset and c."column"=k.target"""

QUERIES["suggest_target"] = lambda s, d: roles.suggest_target(cat(s, d))
SQL["suggest_target"] = CAT + """ select dataset, coalesce(arg_max("column", ordinal) filter (where n_distinct<=20), arg_max("column", ordinal)) suggested from cat group by 1"""


def like_sql(words):
    return "regexp_matches(lower(\"column\"), '" + "|".join(words) + "')"


def first_sql(cond):
    return f'arg_min("column", ordinal) filter (where {cond})'


NUMK = "kind in ('int','float')"
TIME = f"""tc as (select dataset, coalesce({first_sql(like_sql(fixed.TIME_WORDS) + " and kind in ('int','float','string','timestamp')")}, {first_sql(NUMK)}) time_col,
 {first_sql(like_sql(fixed.TIME_WORDS_GENERATOR) + " and kind in ('int','float','string','timestamp')")} generator_time_col from cat group by 1)"""
QUERIES["detect_time_col"] = lambda s, d: (lambda c: roles.detect_time_column(c).join(
    roles.detect_time_column(c, fixed.TIME_WORDS_GENERATOR, False).withColumnRenamed("time_col", "generator_time_col"), "dataset"))(names(s, d))
SQL["detect_time_col"] = CAT + ", " + TIME + " select dataset, time_col, generator_time_col from tc"

QUERIES["detect_entity_col"] = lambda s, d: roles.detect_entity_column(names(s, d))
SQL["detect_entity_col"] = CAT + ", " + TIME + f""" select c.dataset, any_value(time_col) time_col, {first_sql(like_sql(fixed.ENTITY_WORDS) + ' and not coalesce("column"=time_col,false)')} entity_col
 from cat c join tc on c.dataset=tc.dataset group by 1"""

QUERIES["detect_text_col"] = lambda s, d: roles.detect_text_column(cat(s, d), con(s))
SQL["detect_text_col"] = CAT + """, x as (select c.*, kind='string' and not coalesce(c."column"=k.target,false) ok from cat c left join contracts k on c.dataset=k.dataset)
 select dataset, case when max(avg_len) filter (where ok)>=20 then arg_max("column", (avg_len,-ordinal)) filter (where ok) end longest,
 arg_min("column", ordinal) filter (where kind='string' and avg_len>50) first_long from x group by 1"""

QUERIES["detect_path_col"] = lambda s, d: roles.detect_path_column(names(s, d))
SQL["detect_path_col"] = CAT + f" select dataset, {first_sql(like_sql(fixed.PATH_WORDS))} path_col from cat group by 1"

QUERIES["pick_sensitive"] = lambda s, d: roles.pick_sensitive(cat(s, d), con(s))
SQL["pick_sensitive"] = CAT + f""", x as (select c.*, case when kind='string' then 0 else 1 end g from cat c left join contracts k on c.dataset=k.dataset
  where not coalesce(c."column"=k.target,false) and ((kind='string' and n_distinct between 2 and 10) or ({NUMK} and n_distinct between 2 and 5)))
 select dataset, coalesce(arg_min("column", (g,ordinal)) filter (where {like_sql(fixed.DEMOGRAPHIC_WORDS)}), arg_min("column", (n_distinct,g,ordinal))) sensitive from x group by 1"""


def sens_case():
    c = "case"
    for lvl, words in zip((3, 2, 1), fixed.SENSITIVITY_WORDS.values()):
        c += f" when {like_sql(words)} then {lvl}"
    return c + " else 0 end"


QUERIES["sensitivity"] = lambda s, d: ledger.sensitivity(names(s, d))
SQL["sensitivity"] = CAT + f""" select dataset, (['low','medium','high','critical'])[r+1] sensitivity, ([10.0,3.0,1.0,0.5])[r+1]::double epsilon_cap
 from (select dataset, max({sens_case()}) r from cat group by 1)"""


def enforce_query(s, d):
    """Events forced into the shape of orders: shared nothing, so every column is filled; then customers against suppliers."""
    li = T.load_table(s, d, "lineitem")
    partial = li.select("l_orderkey", (F.col("l_quantity") * 2).alias("l_quantity"), F.col("l_returnflag"), F.lit(1).alias("stray"))
    return prepare.enforce(partial, li.drop("l_shipdate"))


QUERIES["schema_enforce"] = enforce_query
SQL["schema_enforce"] = """select l_orderkey, 0::bigint l_partkey, 0::bigint l_suppkey, 0::int l_linenumber, l_quantity*2 l_quantity, 0.0::double l_extendedprice, 0.0::double l_discount,
 0.0::double l_tax, l_returnflag, '' l_linestatus from lineitem"""

QUERIES["discrete_to_string"] = lambda s, d: prepare.discrete_to_string(T.load_table(s, d, "part"), ["p_size", "p_brand"]).select("p_partkey", "p_size", "p_brand")
SQL["discrete_to_string"] = "select p_partkey, p_size::varchar p_size, p_brand from part"

QUERIES["coerce_numeric"] = lambda s, d: T.load_table(s, d, "customer").select(
    "c_custkey", *[pairs.as_double(c, "string").alias(c) for c in ["c_name", "c_mktsegment"]],
    F.regexp_replace("c_name", "Customer#", "").try_cast("double").alias("c_number"))
SQL["coerce_numeric"] = "select c_custkey, try_cast(c_name as double) c_name, try_cast(c_mktsegment as double) c_mktsegment, try_cast(replace(c_name,'Customer#','') as double) c_number from customer"


def sparse_orders(s, d):
    o = T.load_table(s, d, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
                    F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))


SPARSE_SQL = "so as (select o_orderkey, case when o_orderkey%7<>0 then o_totalprice end o_totalprice, case when o_orderkey%5<>0 then o_orderstatus end o_orderstatus from orders)"
QUERIES["complete_cases"] = lambda s, d: prepare.complete_cases(sparse_orders(s, d), ["o_totalprice", "o_orderstatus"]).where(F.col("o_orderstatus") == "F")
SQL["complete_cases"] = f"with {SPARSE_SQL} select * from so where o_totalprice is not null and o_orderstatus='F'"


# ---- profiles
def targets():
    return {c.name: c.target for c in V.contracts() if c.name in V.TABLES}


def profile_all(s, d):
    out = None
    for t, df in V.all_tables(s, d).items():
        one = profile.profile(df, t, targets().get(t))
        out = one if out is None else out.unionAll(one)
    return rounded(out.drop("null_frac"), "sparsity", "imbalance")


def imbalance_sql(t, target):
    return f"(select case when count(*)>=2 then max(n)::double/min(n) else 1.0 end from (select count(*) n from {t} where {target} is not null group by {target}))"


def profile_sql(t, target):
    cols = V.columns_of(t)
    num = [c for c, k in cols if k in ("int", "float")]
    nulls = "+".join(f"(count(*)-count({c}))" for c, _ in cols)
    zeros = "+".join(f"count(*) filter (where {c}=0)" for c in num)
    has = target in [c for c, _ in cols]
    return f"""select '{t}' dataset, count(*) n_rows, {len(cols)} n_cols, {len(num)} n_numeric, {len(cols) - len(num)} n_categorical,
 round(least(1,({nulls})/(count(*)*{len(cols)}.0)+0.5*({zeros})/(count(*)*{len(num)}.0)),6) sparsity, round({imbalance_sql(t, target) if has else '1.0'},6)::double imbalance, {str(has).lower()} has_target from {t}"""


QUERIES["profile"] = profile_all
SQL["profile"] = " union all ".join(profile_sql(t, targets().get(t)) for t in V.TABLES)


def meta_all(s, d):
    out = None
    for t in V.TABLES:
        one = profile.meta_features(T.load_table(s, d, t), t, targets().get(t))
        out = one if out is None else out.unionAll(one)
    return rounded(out, "sparsity", "imbalance", "mean_cardinality")


def meta_sql(t):
    cats = [c for c, k in V.columns_of(t) if k not in ("int", "float")]
    cols = V.columns_of(t)
    nulls = "+".join(f"(count(*)-count({c}))" for c, _ in cols)
    return f"""select p.dataset, n_rows, n_cols, n_numeric, n_categorical, sparsity, imbalance, has_missing, round(mc,6) mean_cardinality from ({profile_sql(t, targets().get(t))}) p,
 (select (case when ({nulls})/(count(*)*{len(cols)}.0)>0.01 then 1.0 else 0.0 end)::double has_missing, ({'+'.join(f'count(distinct {c})' for c in cats) or '0'})/{max(len(cats), 1)}.0 mc from {t})"""


QUERIES["meta_features"] = meta_all
SQL["meta_features"] = " union all ".join(meta_sql(t) for t in V.TABLES)

QUERIES["sparsity"] = lambda s, d: rounded(profile.sparsity(sparse_orders(s, d)), "null_frac", "zero_frac", "sparsity")
SQL["sparsity"] = f"""with {SPARSE_SQL}, x as (select ((count(*)-count(o_totalprice))+(count(*)-count(o_orderstatus)))/(count(*)*3.0) nf,
 (count(*) filter (where o_totalprice=0)+count(*) filter (where o_orderkey=0))/(count(*)*2.0) zf from so)
 select round(nf,6) null_frac, round(zf,6) zero_frac, round(least(1,nf+0.5*zf),6) sparsity from x"""

QUERIES["imbalance"] = lambda s, d: rounded(profile.imbalance(T.load_table(s, d, "lineitem"), "l_returnflag"), "imbalance")
SQL["imbalance"] = f"select (select count(distinct l_returnflag) from lineitem) n_classes, round({imbalance_sql('lineitem', 'l_returnflag')},6) imbalance"

NUM = V.LINE_NUMERIC
QUERIES["diversity"] = lambda s, d: rounded(profile.diversity(V.lineitem_pair(s, d), NUM), "sd_real", "sd_synth", "diversity")
SQL["diversity"] = f"""with {V.LINEITEM_PAIR_SQL}, x as (select ({'+'.join(f"stddev_samp({c}) filter (where side='real')" for c in NUM)})/{len(NUM)} a,
 ({'+'.join(f"stddev_samp({c}) filter (where side='synth')" for c in NUM)})/{len(NUM)} b from lineitem_pair)
 select round(a,6) sd_real, round(b,6) sd_synth, round(greatest(0,least(1,b/(a+1e-6))),6) diversity from x"""

QUERIES["class_distribution"] = lambda s, d: profile.class_distribution(V.lineitem_pair(s, d), "l_returnflag")
SQL["class_distribution"] = f"with {V.LINEITEM_PAIR_SQL} select side, l_returnflag as \"class\", count(*) n from lineitem_pair group by 1,2"

QUERIES["size_ratio"] = lambda s, d: rounded(profile.size_ratio(V.lineitem_pair(s, d), "ctgan"), "ratio")
SQL["size_ratio"] = f"with {V.LINEITEM_PAIR_SQL} select n_real, n_synth, round(n_synth::double/n_real,6) ratio, 'CTGAN' model from (select count(*) filter (where side='real') n_real, count(*) filter (where side='synth') n_synth from lineitem_pair)"

# ---- preparation
SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def standardize(s, d):
    li = T.load_table(s, d, "lineitem").select("l_orderkey", *SCALED)
    return rounded(prepare.Scaler.fit(li, SCALED).transform(li), *SCALED)


QUERIES["standardize"] = standardize
SQL["standardize"] = f"""with m as (select {', '.join(f"avg({c}) m_{c}, coalesce(nullif(stddev_pop({c}),0),1) s_{c}" for c in SCALED)} from lineitem)
 select l_orderkey, {', '.join(f"round(({c}-m_{c})/s_{c},6) {c}" for c in SCALED)} from lineitem, m"""


def standardize_roundtrip(s, d):
    li = T.load_table(s, d, "lineitem").select("l_orderkey", *SCALED)
    sc = prepare.Scaler.fit(li, SCALED)
    return rounded(sc.inverse(sc.transform(li)), *SCALED)


QUERIES["standardize_roundtrip"] = standardize_roundtrip
SQL["standardize_roundtrip"] = f"select l_orderkey, {', '.join(f'round({c},6) {c}' for c in SCALED)} from lineitem"


def label_query(s, d):
    """Codes of the priority column, and the labels they decode back to after a small disturbance."""
    o = T.load_table(s, d, "orders").select("o_orderkey", "o_orderpriority")
    codes = prepare.label_codes(o, "o_orderpriority")
    enc = prepare.label_encode(o, "o_orderpriority", codes).withColumnRenamed("o_orderpriority", "code")
    noisy = enc.withColumn("o_orderpriority", F.col("code") + rng.uniform("o_orderkey", "wobble") * 3 - 1.5)
    return prepare.label_decode(noisy, "o_orderpriority", codes).withColumnRenamed("o_orderpriority", "decoded")


QUERIES["label_encode"] = label_query
SQL["label_encode"] = f"""with codes as (select v, row_number() over (order by v)-1 code from (select distinct o_orderpriority v from orders)),
 e as (select o_orderkey, code, least(greatest(round_even(code+{u_sql('o_orderkey', 'wobble')}*3-1.5,0)::bigint,0),(select max(code) from codes)) near from orders join codes on v=o_orderpriority)
 select o_orderkey, e.code, c.v decoded from e join codes c on c.code=e.near"""


def one_hot_view(s, d):
    """Order lines with their return flag spread over one-hot columns; the l_ columns share a prefix but are not binary."""
    li = T.load_table(s, d, "lineitem")
    hot = [(F.col("l_returnflag") == v).cast("int").alias(f"flag_{v}") for v in ("A", "N", "R")]
    hot += [(F.col("l_linestatus") == v).cast("int").alias(f"line_status_{v}") for v in ("F", "O")]
    return li.select("l_orderkey", "l_linenumber", "l_quantity", *hot)


QUERIES["ohe_groups"] = lambda s, d: prepare.one_hot_groups(one_hot_view(s, d)).withColumn("members", F.array_join("members", ","))
SQL["ohe_groups"] = """with v as (select bool_and((l_returnflag='A')::int in (0,1) and (l_returnflag='N')::int in (0,1) and (l_returnflag='R')::int in (0,1)) f,
  bool_and((l_linestatus='F')::int in (0,1) and (l_linestatus='O')::int in (0,1)) st, bool_and(l_orderkey in (0,1) and l_linenumber in (0,1) and l_quantity in (0,1)) l from lineitem)
 select 'flag' as "prefix", 'flag_A,flag_N,flag_R' members from v where f union all select 'line_status','line_status_F,line_status_O' from v where st
 union all select 'l','l_orderkey,l_linenumber,l_quantity' from v where l"""


def collapse_query(s, d):
    v = one_hot_view(s, d)
    groups = {r["prefix"]: r["members"] for r in prepare.one_hot_groups(v).collect()}
    return prepare.one_hot_collapse(v, groups)


QUERIES["ohe_collapse"] = collapse_query
SQL["ohe_collapse"] = "select l_orderkey, l_linenumber, l_quantity, case when l_returnflag in ('A','N','R') then l_returnflag else 'A' end flag, case when l_linestatus in ('F','O') then l_linestatus else 'F' end line_status from lineitem"


def clamp_query(s, d):
    e = T.load_table(s, d, "events").select("event_id", "user_id", "value")
    fitted = prepare.Ranges.fit(e, ["user_id", "value"])
    noisy = e.select("event_id", (F.col("user_id") * 1.4 + rng.uniform("event_id", "cu") - 20).alias("user_id"), (F.col("value") * 1.3 - rng.uniform("event_id", "cv")).alias("value"))
    return rounded(fitted.restore(noisy), "value")


QUERIES["clamp_round"] = clamp_query
SQL["clamp_round"] = f"""with r as (select min(user_id) ul, max(user_id) uh, min(value) vl, max(value) vh from events)
 select event_id, round_even(greatest(ul,least(uh,user_id*1.4::double+{u_sql('event_id', 'cu')}-20)),0)::bigint user_id,
 round(round_even(greatest(vl,least(vh,value*1.3::double-{u_sql('event_id', 'cv')})),2),6) value from events, r"""

QUERIES["decimal_places"] = lambda s, d: prepare.decimal_places(T.load_table(s, d, "lineitem"), NUM)
SQL["decimal_places"] = " union all ".join(
    f"select '{c}' \"column\", " + ("any_value(0)" if k == "int" else f"max(length(split_part({c}::varchar,'.',2)))::int") + " decimals from lineitem"
    for c, k in V.columns_of("lineitem") if k in ("int", "float"))


def skewed_orders(s, d):
    """Orders with a rare class: one status value is kept for a fifteenth of its orders and the rest joins another."""
    o = T.load_table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.withColumn("o_orderstatus", F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 15 != 0), "F").otherwise(F.col("o_orderstatus")))


SKEWED_SQL = "sk as (select o_orderkey, case when o_orderstatus='P' and o_orderkey%15<>0 then 'F' else o_orderstatus end o_orderstatus, o_totalprice from orders)"
QUERIES["balance_classes"] = lambda s, d: rounded(prepare.balance_classes(skewed_orders(s, d), "o_orderstatus", "o_orderkey"), "o_totalprice")
SQL["balance_classes"] = f"""with {SKEWED_SQL}, r as (select *, row_number() over (partition by o_orderstatus order by {u_sql('o_orderkey', 'balance')}, o_orderkey) rn from sk),
 c as (select o_orderstatus k, count(*) n, least(greatest((select floor(count(*)/count(distinct o_orderstatus)) from sk),1),4*count(*))::bigint dr from sk group by 1),
 sl as (select k, n, unnest(range(1, dr+1)) slot from c where n<dr)
 select o_orderkey, o_orderstatus, round(o_totalprice,6) o_totalprice, rn slot from r join c on k=o_orderstatus where n>=dr and rn<=dr
 union all select o_orderkey, o_orderstatus, round(o_totalprice,6), slot from sl join r on r.o_orderstatus=sl.k
  and r.rn=least(floor({u_sql("(sl.k||'/'||slot::varchar)", 'balance-draw')}*n)::bigint,n-1)+1"""

QUERIES["subsample"] = lambda s, d: prepare.subsample(T.load_table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500)
SQL["subsample"] = f"select o_orderkey, o_totalprice from orders order by {u_sql('o_orderkey', 'subsample')}, o_orderkey limit 500"

QUERIES["split_holdout"] = lambda s, d: prepare.split_holdout(T.load_table(s, d, "orders"), "o_orderkey").select("o_orderkey", "part")
SQL["split_holdout"] = f"select o_orderkey, case when {u_sql('o_orderkey', 'holdout')}<0.6 then 'train' else 'holdout' end part from orders"

QUERIES["split_stratified"] = lambda s, d: prepare.split_stratified(T.load_table(s, d, "orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "o_orderstatus", "part")
SQL["split_stratified"] = f"""select o_orderkey, o_orderstatus, case when (rn-1)::double/n<0.7 then 'train' else 'holdout' end part from
 (select *, row_number() over (partition by o_orderstatus order by {u_sql('o_orderkey', 'strata')}, o_orderkey) rn, count(*) over (partition by o_orderstatus) n from orders)"""


def pca_query(s, d):
    """Embeddings as 64 columns, compressed to 50 components and expanded again; the mean squared loss per label."""
    e = T.load_table(s, d, "embeddings")
    wide = e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    cols = [f"x{i}" for i in range(64)]
    c = prepare.Compressor.fit(wide, cols)
    back = c.inverse(c.transform(wide, ["vec_id"]), ["vec_id"])
    j = wide.join(back.select("vec_id", *[F.col(x).alias(f"y_{x}") for x in cols]), "vec_id")
    loss = sum(((F.col(x) - F.col(f"y_{x}")) ** 2 for x in cols[1:]), (F.col("x0") - F.col("y_x0")) ** 2) / 64
    return j.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(loss)).alias("mean_loss"))


QUERIES["pca_compress"] = pca_query
