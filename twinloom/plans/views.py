"""The views the checked queries read: whole tables, with a side or a role added to each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinloom.functions.pairs import REAL, SIDE, SYNTH
from twinloom.sources.tables import load_table

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def side_of(key: str):
    """Every row goes to one of the two sides, by the parity of its key."""
    return F.element_at(F.array(F.lit(REAL), F.lit(SYNTH)), (F.pmod(F.col(key), F.lit(2)) + 1).cast("int"))


def lineitem_pair(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a pair; quantities on the synthetic side are a tenth too large."""
    t = load_table(spark, d, "lineitem").withColumn(SIDE, side_of("l_orderkey"))
    return t.withColumn("l_quantity", F.when(F.col(SIDE) == SYNTH, F.col("l_quantity") * 1.1).otherwise(F.col("l_quantity")))


LINEITEM_PAIR_SQL = """lineitem_pair as (
 select case when l_orderkey % 2 = 0 then 'real' else 'synth' end side, l_orderkey, l_partkey, l_suppkey, l_linenumber,
        case when l_orderkey % 2 = 0 then l_quantity else l_quantity * 1.1 end l_quantity,
        l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate from lineitem)"""

LINE_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def customer_pair(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "customer").withColumn(SIDE, side_of("c_custkey"))


CUSTOMER_PAIR_SQL = """customer_pair as (
 select case when c_custkey % 2 = 0 then 'real' else 'synth' end side, * from customer)"""


def orders_pair(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "orders").withColumn(SIDE, side_of("o_orderkey"))


ORDERS_PAIR_SQL = """orders_pair as (
 select case when o_orderkey % 2 = 0 then 'real' else 'synth' end side, * from orders)"""


def events_pair(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "events").withColumn(SIDE, side_of("event_id"))


EVENTS_PAIR_SQL = """events_pair as (
 select case when event_id % 2 = 0 then 'real' else 'synth' end side, * from events)"""


def docs_labelled(spark: SparkSession, d: str) -> DataFrame:
    docs = load_table(spark, d, "documents")
    return docs.join(load_table(spark, d, "labels"), "doc_id")


DOCS_LABELLED_SQL = """docs_labelled as (select d.*, l.quality, l.toxic from documents d join labels l on d.doc_id = l.doc_id)"""


SCORES = {"privacy": 37, "utility": 53, "realism": 71, "diversity": 89, "mia": 97, "singling": 101, "leak": 103, "causal": 107, "temporal": 109}
EVENT_MODELS = {"signup": "ctgan", "purchase": "tabddpm", "click": "llm", "view": "gnn", "error": "diffusion"}
MODALITIES = ["tabular", "text", "image", "graph", "tabular"]
CAPS = [0.5, 1.0, 3.0, 10.0]


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Every event read as one generation attempt; two attempts make a run."""
    from twinloom.operators.runs import reward

    e = load_table(spark, d, "events")
    i = F.col("event_id")
    model = F.create_map(*[F.lit(x) for kv in EVENT_MODELS.items() for x in kv])[F.col("event_type")]
    run = F.floor(i / 2)
    base = e.select(
        i.alias("seq"), run.alias("run_id"), (i % 2).alias("attempt"), F.concat(F.lit("ds"), (run % 20).cast("string")).alias("dataset"),
        model.alias("model"), F.col("ts"), *[((i * k) % 1000 / 1000.0).alias(c) for c, k in SCORES.items()],
        F.when(i % 97 == 5, F.lit(float("nan"))).otherwise((i * SCORES["utility"]) % 1000 / 1000.0).alias("utility_raw"),
        (F.col("value") / 10).alias("epsilon"), (100 + (i * 13) % 20000).alias("n_rows"), (2 + (i * 7) % 600).alias("n_cols"),
        ((i * 61) % 1000 / 1000.0).alias("sparsity"), (1 + (i * 17) % 80 / 10.0).alias("imbalance"),
        F.element_at(F.array(*[F.lit(m) for m in MODALITIES]), (i % 5 + 1).cast("int")).alias("modality"), (i % 11 == 0).alias("is_temporal"),
        F.element_at(F.array(*[F.lit(c) for c in CAPS]), (run % 4 + 1).cast("int")).alias("epsilon_cap"),
    )
    return base.withColumn("reward", reward(utility="utility_raw"))


RUNS_SQL = f"""runs0 as (
 select event_id seq, event_id//2 run_id, event_id%2 attempt, 'ds'||((event_id//2)%20)::varchar dataset,
  case event_type {' '.join(f"when '{e}' then '{m}'" for e, m in EVENT_MODELS.items())} end model, ts,
  {', '.join(f"(event_id*{k})%1000/1000.0::double {c}" for c, k in SCORES.items())},
  case when event_id%97=5 then 'nan'::double else (event_id*53)%1000/1000.0::double end utility_raw,
  value/10 epsilon, 100+(event_id*13)%20000 n_rows, 2+(event_id*7)%600 n_cols, (event_id*61)%1000/1000.0::double sparsity,
  1+(event_id*17)%80/10.0::double imbalance,
  (array[{', '.join(f"'{m}'" for m in MODALITIES)}])[event_id%5+1] modality, event_id%11=0 is_temporal,
  (array[0.5,1.0,3.0,10.0])[(event_id//2)%4+1]::double epsilon_cap from events),
 runs as (select *, greatest(0,least(1,0.4*privacy+0.3*(case when isnan(utility_raw) then 0 else utility_raw end)+0.2*realism+0.1*diversity)) reward from runs0)"""


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a ledger entry; each thousandth one is a reset marker."""
    e = load_table(spark, d, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("seq"), "ts", F.concat(F.lit("ds"), (F.floor(i / 2) % 20).cast("string")).alias("dataset"),
        F.when(i % 1000 == 0, "reset").otherwise("spend").alias("kind"), (F.col("value") / 10).alias("epsilon"),
    )


LEDGER_SQL = """ledger as (select event_id seq, ts, 'ds'||((event_id//2)%20)::varchar dataset,
 case when event_id%1000=0 then 'reset' else 'spend' end kind, value/10 epsilon from events),
 live as (select * from ledger where kind='spend' and seq > (select coalesce(max(seq),-1) from ledger where kind='reset'))"""


# name and kind of every column of the given tables
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey int, c_name string, c_nationkey int, c_acctbal float, c_mktsegment string",
    "supplier": "s_suppkey int, s_name string, s_nationkey int, s_acctbal float",
    "part": "p_partkey int, p_name string, p_brand string, p_type string, p_size int, p_retailprice float",
    "orders": "o_orderkey int, o_custkey int, o_orderstatus string, o_totalprice float, o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity float, l_extendedprice float, l_discount float, l_tax float, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    "events": "event_id int, ts timestamp, user_id int, event_type string, value float, props string",
    "documents": "doc_id int, text string, lang string, source string, n_chars int",
    "embeddings": "vec_id int, embedding array, label int",
    "pages": "page_id int, url string, html string",
    "benchmark": "item_id int, text string",
    "labels": "doc_id int, quality int, toxic int",
    "conversations": "conv_id int, turn int, role string, text string",
}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.strip().split(" ")) for c in COLUMNS[table].split(",")]


def catalogue_sql() -> str:
    parts = []
    for t in TABLES:
        for i, (c, k) in enumerate(columns_of(t)):
            num = k in ("int", "float")
            parts.append(
                f"select '{t}' dataset, {i} ordinal, '{c}' \"column\", '{k}' kind, count(*) n_rows, count({c}) n_nonnull, count(distinct {c}) n_distinct, "
                + (f"avg(length({c}))" if k == "string" else "null::double") + " avg_len, "
                + (f"min({c})::double lo, max({c})::double hi, count(*) filter (where abs({c}-round({c},0))>=0.01) off_whole" if num else "null::double lo, null::double hi, null::bigint off_whole")
                + f" from {t}")
    return "cat as (" + " union all ".join(parts) + ")"


def contracts():
    from twinloom.operators.roles import Contract

    return [
        Contract("lineitem", "l_returnflag", "tabular", description="order lines"),
        Contract("orders", "o_orderstatus", "tabular", is_temporal=True, description="orders"),
        Contract("customer", "c_mktsegment", "tabular", discrete=("c_mktsegment", "c_nationkey"), description="customers"),
        Contract("supplier", "s_region", "tabular", description="suppliers; the named target is absent"),
        Contract("part", "p_size", "", description="parts"),
        Contract("events", "event_type", "graph", is_temporal=True, description="event sequences"),
        Contract("documents", "lang", "text", description="documents"),
        Contract("labels", "quality", "unknown", description="labels"),
        Contract("pages", None, "", description="web pages"),
        Contract("conversations", "role", "", description="turns"),
        Contract("nation", "n_regionkey", "tabular", description="nations"),
        Contract("returns", "reason", "tabular", description="registered, but no table is there"),
    ]


def contracts_sql() -> str:
    def lit(x):
        return "null" if x is None else f"'{x}'"

    rows = ", ".join(
        f"('{c.name}', {lit(c.target)}::varchar, '{c.modality}', {str(c.is_temporal).lower()}, "
        + ("null::varchar[]" if c.discrete is None else "[" + ", ".join(lit(x) for x in c.discrete) + "]") + ")"
        for c in contracts())
    return f"contracts(dataset, target, modality, is_temporal, discrete) as (values {rows})"


def all_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: load_table(spark, d, t) for t in TABLES}
