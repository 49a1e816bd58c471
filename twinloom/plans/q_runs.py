"""Checked queries: decisions, history and the budget ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from twinloom.functions import fixed
from twinloom.functions.scalars import r6
from twinloom.operators import ledger, runs as R
from twinloom.plans import views as V
from twinloom.plans.q_compare import rounded
from twinloom.session import checkpoint_dir
from twinloom.sources import logs

QUERIES, SQL = {}, {}


def gate_sql(view, out="gated", floors=None):
    f = floors or {k: f"{v}::double" for k, v in fixed.FLOORS.items()}
    p, m, s, a, u = f["privacy"], f["mia"], f["singling"], f["leak"], f["utility"]
    return f"""{out} as (select *, not (privacy<{p} or mia<{m} or singling<{s} or leak<{a}) released,
  case when privacy<{p} then 'BLOCKED: privacy '||printf('%.3f',privacy)||' < floor '||({p})::varchar
   when mia<{m} then 'BLOCKED: MIA '||printf('%.3f',mia)||' < '||({m})::varchar
   when singling<{s} then 'BLOCKED: singling-out '||printf('%.3f',singling)||' < '||({s})::varchar
   when leak<{a} then 'BLOCKED: attr-leakage '||printf('%.3f',leak)||' < '||({a})::varchar
   when utility<{u} then 'WARNING: utility '||printf('%.3f',utility)||' < target '||printf('%.2f',{u})||' — releasing with low-utility caveat'
   else 'APPROVED' end gate_message from {view})"""


BASE = "with " + V.RUNS_SQL
GATED = BASE + ", " + gate_sql("runs")
ARCHIVE = GATED + """, arch as (select *, list_filter([
  case when not released and lower(gate_message) like '%privacy%' then 'privacy_gate_fail:'||model end,
  case when not released and lower(gate_message) like '%singling%' then 'singling_out_fail:'||model end,
  case when not released and lower(gate_message) like '%attr-leakage%' then 'attr_leak_fail:'||model end,
  case when not released and lower(gate_message) like '%mia%' then 'mia_fail:'||model end,
  case when utility<0.4 then case when model='tabddpm' and n_cols>500 then 'tabddpm_high_dim_utility_collapse'
    when model='ctgan' and sparsity>0.6 then 'ctgan_sparse_utility_collapse' when model='llm' then 'llm_template_low_utility'
    else 'low_utility:'||model end end,
  case when realism<0.4 then 'low_realism:'||model end,
  case when privacy<0.7 then 'low_privacy:'||model end], lambda x: x is not null) failure_reasons from gated)"""

QUERIES["reward"] = lambda s, d: V.runs(s, d).select("seq", r6(F.col("reward")).alias("reward"))
SQL["reward"] = BASE + " select seq, round(reward,6) reward from runs"

QUERIES["release_gate"] = lambda s, d: R.gate(V.runs(s, d)).select("seq", "released", "gate_message")
SQL["release_gate"] = GATED + " select seq, released, gate_message from gated"

QUERIES["model_chain"] = lambda s, d: R.model_chain(V.runs(s, d)).select("seq", "position", "candidate")
SQL["model_chain"] = BASE + """, c as (select seq, model, case modality when 'tabular' then ['ctgan','tabddpm'] when 'text' then ['llm']
  when 'image' then ['diffusion'] when 'graph' then ['gnn','ctgan'] else [model] end chain, modality, n_rows from runs),
 o as (select seq, case when modality='tabular' and model='tabddpm' and n_rows<10000 then ['ctgan','tabddpm']
   else list_concat([model], list_filter(chain, lambda x: x<>model)) end l from c)
 select seq, (unnest(range(len(l))))::int as "position", unnest(l) candidate from o"""

SELECT_SQL = """select run_id, c.attempt attempt, c.model model, round(c.epsilon,6) epsilon, round(c.reward,6) reward,
  c.gate_message || case when forced then ' [forced-release after '||n::varchar||'-model chain exhausted]' else '' end gate_message, forced
 from (select run_id, count(*) n, count(*) filter (where released)=0 forced,
  coalesce(arg_min({'attempt':attempt,'model':model,'epsilon':epsilon,'reward':reward,'gate_message':gate_message}, attempt) filter (where released),
           arg_max({'attempt':attempt,'model':model,'epsilon':epsilon,'reward':reward,'gate_message':gate_message}, (reward, -attempt))) c
  from gated group by 1)"""
QUERIES["select_attempt"] = lambda s, d: rounded(R.select_attempt(R.gate(V.runs(s, d))), "epsilon", "reward")
SQL["select_attempt"] = GATED + " " + SELECT_SQL

RELAX = {k: (f"(case when attempt=0 then {v} else {fixed.RELAXED_FLOORS[k]} end)::double") for k, v in fixed.FLOORS.items()}
QUERIES["gate_relaxed"] = lambda s, d: rounded(R.gate_relaxed(V.runs(s, d)), "epsilon", "reward")
SQL["gate_relaxed"] = BASE + ", " + gate_sql("runs", floors=RELAX) + " " + SELECT_SQL

ROUTED = BASE + """, rt as (select *, case when modality='image' then 'diffusion' when modality='text' then 'llm' when is_temporal or modality='graph' then 'gnn'
   when n_rows>5000 and n_cols>=50 then 'tabddpm' when imbalance>3 or sparsity>0.5 then 'ctgan' when n_rows>10000 and n_cols>=10 then 'tabddpm' else 'ctgan' end routed,
  least(epsilon_cap, case when modality='image' then 1.0 when modality='text' then 3.0 when is_temporal or modality='graph' then 1.0
   when n_rows>5000 and n_cols>=50 then 0.7 when imbalance>3 or sparsity>0.5 then 1.0 when n_rows>10000 and n_cols>=10 then 0.7 else 1.0 end)::double epsilon_routed,
  case when modality='image' then 'image modality' when modality='text' then 'text modality' when is_temporal or modality='graph' then 'temporal or graph'
   when n_rows>5000 and n_cols>=50 then 'large and wide table' when imbalance>3 or sparsity>0.5 then 'imbalanced or sparse'
   when n_rows>10000 and n_cols>=10 then 'large table' else 'small or medium table' end reason from runs)"""
KEYS = "['ctgan','diffusion','ensemble','gnn','llm','tabddpm']"
QUERIES["route"] = lambda s, d: R.route(V.runs(s, d)).select("seq", "routed", "epsilon_routed", "reason", F.array_join("skip_models", ",").alias("skip_models"))
SQL["route"] = ROUTED + f" select seq, routed, epsilon_routed, reason, array_to_string(list_filter({KEYS}, lambda x: x<>routed),',') skip_models from rt"

QUERIES["failure_signatures"] = lambda s, d: R.archive(V.runs(s, d)).select("seq", "model", F.array_join("failure_reasons", ";").alias("failure_reasons"))
SQL["failure_signatures"] = ARCHIVE + " select seq, model, array_to_string(failure_reasons,';') failure_reasons from arch"

QUERIES["archive_store"] = lambda s, d: rounded(R.archive(V.runs(s, d)).select(
    "seq", "dataset", "model", "reward", "epsilon", "released", F.size("failure_reasons").alias("n_failures"), F.col("ts").alias("stored_at"),
    F.col("n_rows").alias("meta_rows"), F.col("n_cols").alias("meta_cols")), "reward", "epsilon")
SQL["archive_store"] = ARCHIVE + """ select seq, dataset, model, round(reward,6) reward, round(epsilon,6) epsilon, released,
 len(failure_reasons)::int n_failures, ts stored_at, n_rows meta_rows, n_cols meta_cols from arch"""

AVOID = """, idx as (select model m, min(seq) filter (where list_contains(failure_reasons,'tabddpm_high_dim_utility_collapse')) fd,
  min(seq) filter (where list_contains(failure_reasons,'ctgan_sparse_utility_collapse')) fs,
  min(seq) filter (where list_contains(failure_reasons,'privacy_gate_fail:'||model)) fg from arch group by 1)"""


def avoid_sql(src, model):
    return f"""av as (select p.*, list_min(list_filter([
   case when n_cols>400 and fd is not null then (fd,0,'tabddpm previously collapsed on high-dim data') end,
   case when sparsity>0.5 and fs is not null then (fs,1,'ctgan previously collapsed on sparse data') end,
   case when fg is not null then (fg,2,{model}||' previously failed the privacy gate') end], lambda x: x is not null)) hit
  from {src} p left join idx on p.{model}=idx.m)"""


QUERIES["should_avoid"] = lambda s, d: R.should_avoid(V.runs(s, d), R.archive(V.runs(s, d))).select("seq", "avoid", "avoid_reason")
SQL["should_avoid"] = ARCHIVE + AVOID + ", " + avoid_sql("runs", "model") + " select seq, hit is not null avoid, coalesce(hit[3],'') avoid_reason from av"

LADDER = "case routed " + " ".join(f"when '{a}' then '{b}'" for a, b in fixed.LADDER.items()) + " else 'ctgan' end"
HIST = ARCHIVE + AVOID + ROUTED[ROUTED.index(", rt as"):] + ", " + avoid_sql("rt", "routed") + f""",
 rh as (select *, case when hit is not null then {LADDER} else routed end chosen,
  case when hit is not null then least(1.0,epsilon_cap)::double else epsilon_routed end epsilon_chosen, hit is not null fallback_used from av)"""
QUERIES["route_with_history"] = lambda s, d: R.route_with_history(V.runs(s, d), R.archive(V.runs(s, d))).select(
    "seq", "routed", "chosen", "epsilon_chosen", "fallback_used", "avoid_reason")
SQL["route_with_history"] = HIST + " select seq, routed, chosen, epsilon_chosen, fallback_used, coalesce(hit[3],'') avoid_reason from rh"

QUERIES["failures_by_model"] = lambda s, d: R.failures_by_model(R.archive(V.runs(s, d))).select("model", "n_failures", F.array_join("reasons", ";").alias("reasons"))
SQL["failures_by_model"] = ARCHIVE + """ select model, count(*) n_failures, array_to_string(list_sort(list(distinct reason)),';') reasons
 from (select model, unnest(failure_reasons) reason from arch) group by 1"""

QUERIES["best_run"] = lambda s, d: rounded(R.best_run(R.archive(V.runs(s, d))), "reward")
SQL["best_run"] = BASE + " select seq, model, round(reward,6) reward from runs order by reward desc, seq limit 1"

QUERIES["reward_by_model"] = lambda s, d: R.reward_by_model(V.runs(s, d))
SQL["reward_by_model"] = BASE + " select model, count(*) runs, round(avg(reward),4) mean_reward from runs group by 1"


def dataset_profiles(s, d):
    """One profile per dataset of the history: that of its latest run."""
    latest = V.runs(s, d).groupBy("dataset").agg(F.max_by(F.struct("n_rows", "n_cols", "sparsity", "imbalance", "modality", "is_temporal", "epsilon_cap"), "seq").alias("p"))
    return latest.select("dataset", "p.*")


PROFILES_SQL = """, prof as (select * from runs qualify row_number() over (partition by dataset order by seq desc)=1)"""
META = PROFILES_SQL + """, simi as (select p.dataset, h.model, count(*) n, avg(h.reward) mr, avg(h.epsilon) me, min(h.seq) fs from prof p join runs h
   on h.n_rows*1.0/greatest(p.n_rows,1) between 0.5 and 2.0 group by all),
 ms as (select p.dataset, s.model is not null and (select count(*) from runs)>=3 confident, s.model, s.mr mean_reward, greatest(0.1,least(10,s.me)) epsilon,
   coalesce((select sum(n) from simi x where x.dataset=p.dataset),0)::bigint n_similar
  from prof p left join (select * from simi qualify row_number() over (partition by dataset order by mr desc, fs)=1) s on p.dataset=s.dataset)"""
QUERIES["meta_select"] = lambda s, d: rounded(R.meta_select(dataset_profiles(s, d), V.runs(s, d)), "mean_reward", "epsilon")
SQL["meta_select"] = BASE + META + " select dataset, confident, model, round(mean_reward,6) mean_reward, round(epsilon,6) epsilon, n_similar from ms"

QUERIES["choose_model"] = lambda s, d: rounded(R.choose_model(dataset_profiles(s, d), R.archive(V.runs(s, d))), "epsilon")
SQL["choose_model"] = HIST + META + """ select m.dataset, confident, coalesce(m.model, r.chosen) model,
 round(case when confident then least(m.epsilon, r.epsilon_cap) else r.epsilon_chosen end,6) epsilon
 from ms m join rh r on r.dataset=m.dataset and r.seq=(select max(seq) from runs x where x.dataset=m.dataset)"""

QUERIES["budget_remaining"] = lambda s, d: rounded(ledger.remaining(V.ledger(s, d), 100000.0), "consumed", "remaining")
SQL["budget_remaining"] = "with " + V.LEDGER_SQL + """ select round(coalesce(sum(epsilon),0),6) consumed, round(greatest(0,100000.0-coalesce(sum(epsilon),0)),6) remaining,
 100000.0-coalesce(sum(epsilon),0)<=0 exhausted from live"""

QUERIES["ledger_after_reset"] = lambda s, d: rounded(ledger.by_dataset(V.ledger(s, d)), "consumed")
SQL["ledger_after_reset"] = "with " + V.LEDGER_SQL + " select dataset, count(*) entries, round(sum(epsilon),6) consumed from live group by 1"

QUERIES["budget_timeline"] = lambda s, d: rounded(ledger.timeline(V.ledger(s, d), "ts").select("seq", "dataset", "epsilon", "cumulative"), "epsilon", "cumulative")
SQL["budget_timeline"] = "with " + V.LEDGER_SQL + """ select seq, dataset, round(epsilon,6) epsilon,
 round(sum(epsilon) over (order by ts rows unbounded preceding),6) cumulative from ledger"""

def gappy_ledger(s, d):
    """The ledger with every seventh entry's time missing."""
    return V.ledger(s, d).withColumn("ts", F.when(F.col("seq") % 7 != 0, F.col("ts")))


QUERIES["budget_timeline_nulls"] = lambda s, d: rounded(ledger.timeline(gappy_ledger(s, d), "ts").select("seq", "dataset", "epsilon", "cumulative"), "epsilon", "cumulative")
SQL["budget_timeline_nulls"] = "with " + V.LEDGER_SQL + """, gl as (select * replace (case when seq%7<>0 then ts end as ts) from ledger) select seq, dataset, round(epsilon,6) epsilon,
 round(sum(epsilon) over (order by ts nulls first, seq rows unbounded preceding),6) cumulative from gl"""

QUERIES["history_kpis"] = lambda s, d: rounded(R.history_kpis(R.gate(V.runs(s, d)), 100000.0), "mean_privacy", "epsilon_spent", "budget_remaining")
SQL["history_kpis"] = GATED + """ select count(*) runs, count(*) filter (where released) approved, round(avg(privacy),6) mean_privacy,
 round(sum(epsilon),6) epsilon_spent, round(greatest(0,100000.0-sum(epsilon)),6) budget_remaining from gated"""

QUERIES["run_table"] = lambda s, d: R.run_table(R.gate(V.runs(s, d)))
PCT = "(round_even({0}*100,0)::int)::varchar||'%'"
SQL["run_table"] = GATED + f""" select seq, dataset, upper(model) model, {PCT.format('privacy')} privacy, {PCT.format('utility')} utility,
 {PCT.format('causal')} causal, {PCT.format('reward')} reward, printf('%.3f',epsilon) epsilon, case when released then 'Yes' else 'No' end released from gated"""

QUERIES["score_trends"] = lambda s, d: rounded(R.score_trends(V.runs(s, d)), "score")
SQL["score_trends"] = BASE + " " + " union all ".join(f"select seq, dataset, '{m}' metric, round({m},6) score from runs" for m in ("privacy", "utility", "causal", "reward"))

QUERIES["dedupe_runs"] = lambda s, d: V.runs(s, d).transform(R.dedupe).select("seq", "dataset", r6(F.col("reward")).alias("reward"))
SQL["dedupe_runs"] = BASE + """ select seq, dataset, round(reward,6) reward from runs r where not exists
 (select 1 from runs e where e.dataset=r.dataset and e.seq<r.seq and abs(e.reward-r.reward)<0.0001)"""

QUERIES["proxy_score"] = lambda s, d: V.runs(s, d).select("seq", r6(R.proxy_score(
    F.col("epsilon"), F.col("modality") != "graph", F.element_at(F.array(F.lit(64), F.lit(128), F.lit(256)), (F.col("seq") % 3 + 1).cast("int")), F.least(F.col("n_rows"), F.lit(500)))).alias("proxy"))
SQL["proxy_score"] = BASE + """ select seq, round(0.4*greatest(0,least(1,1-epsilon/10))+0.3*(case when modality<>'graph' then 0.6 else 0.4 end)
 -(case when (array[64,128,256])[seq%3+1] <= least(n_rows,500)//4 then 0 else 0.1 end),6) proxy from runs"""

GOOD = {"privacy": 0.70, "utility": 0.60, "realism": 0.60, "causal": 0.60, "reward": 0.65}
QUERIES["score_bands"] = lambda s, d: V.runs(s, d).select("seq", R.privacy_strength(F.col("epsilon")).alias("strength"), *[R.score_band(F.col(c), g).alias(f"{c}_band") for c, g in GOOD.items()])
SQL["score_bands"] = BASE + " select seq, case when epsilon<0.5 then 'Strong' when epsilon<2 then 'Moderate' else 'Standard' end strength, " + ", ".join(
    f"case when {c}>={g} then 'good' when {c}>=0.5 then 'fair' else 'poor' end {c}_band" for c, g in GOOD.items()) + " from runs"

QUERIES["audit_record"] = lambda s, d: logs.audit_record(R.archive(V.runs(s, d))).withColumn("failure_reasons", F.array_join("failure_reasons", ";"))
SQL["audit_record"] = ARCHIVE + """ select seq, dataset, model, round(epsilon,4) epsilon, round(privacy,4) privacy, round(utility,4) utility,
 round(diversity,4) diversity, round(realism,4) realism, round(causal,4) causal_fidelity, case when is_temporal then round(temporal,4) end temporal,
 round(reward,4) reward, released, gate_message, array_to_string(failure_reasons,';') failure_reasons from arch"""


def released_runs(s, d):
    g = R.gate(V.runs(s, d)).where("released")
    return g.withColumns({
        "budget_remaining": F.lit(0.0), "output_path": F.concat(F.lit("synthetic_output_"), F.col("dataset")), "sha256": F.sha2(F.col("seq").cast("string"), 256)})


QUERIES["receipt"] = lambda s, d: logs.receipts(released_runs(s, d))
SQL["receipt"] = GATED + """ select 'receipt_'||dataset||'_'||strftime(ts,'%Y-%m-%d_%H-%M-%S')||'.json' file_name,
 to_json({'@context':'https://schema.org/','@type':'Dataset','name':'synthetic_'||dataset,'dateCreated':strftime(ts,'%Y-%m-%dT%H:%M:%S'),
  'generator':{'@type':'SoftwareApplication','name':'twinloom','version':'1.0'},
  'privacyMechanism':{'name':'Calibrated noise','epsilon':round(epsilon,4),'budgetRemaining':0.0::double},'synthesisModel':upper(model),
  'qualityMetrics':{'privacy':round(privacy,4),'utility':round(utility,4),'diversity':round(diversity,4),'realism':round(realism,4),'reward':round(reward,4)},
  'releaseDecision':'APPROVED','outputFile':{'path':'synthetic_output_'||dataset,'sha256':sha256(seq::varchar)}})::varchar receipt from gated where released"""


def archive_lines(s, d):
    """History as JSON lines, some of them cut short and some with a reward that is no number."""
    a = R.archive(V.runs(s, d))
    text = F.to_json(F.struct(
        F.col("model").alias("model_key"), F.when(F.col("seq") % 53 == 0, F.lit(float("nan"))).otherwise(r6(F.col("reward"))).alias("reward"),
        "privacy", "utility", "dataset", "released", "failure_reasons", F.col("n_rows").alias("meta_rows"), F.col("n_cols").alias("meta_cols")))
    return a.select(F.when(F.col("seq") % 41 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value"))


def written(lines):
    """Lines as text files in the shared folder."""
    path = f"{checkpoint_dir(lines.sparkSession)}/lines-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


QUERIES["archive_load"] = lambda s, d: logs.load_archive(s, written(archive_lines(s, d))).groupBy("model_key", "released").agg(
    F.count(F.lit(1)).alias("n"), r6(F.sum("reward")).alias("sum_reward"), r6(F.sum("privacy")).alias("sum_privacy"),
    r6(F.sum("realism")).alias("sum_realism"), F.sum(F.size("failure_reasons")).alias("n_reasons"), F.sum("meta_rows").alias("sum_rows"))
SQL["archive_load"] = ARCHIVE + """ select model model_key, released, count(*) n, round(sum(case when seq%53=0 then 0 else round(reward,6) end),6) sum_reward,
 round(sum(privacy),6) sum_privacy, 0.0::double sum_realism, sum(len(failure_reasons))::bigint n_reasons, sum(n_rows)::bigint sum_rows
 from arch where seq%41<>0 group by all"""


def meta_lines(s, d):
    text = F.to_json(F.struct("n_rows", "n_cols", F.col("model").alias("model_key"), r6(F.col("reward")).alias("reward")))
    return V.runs(s, d).select(F.when(F.col("seq") % 29 == 0, F.lit("{broken")).otherwise(text).alias("value"))


QUERIES["meta_load"] = lambda s, d: logs.load_meta(s, written(meta_lines(s, d))).groupBy("model_key").agg(
    F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("sum_rows"), F.sum("n_cols").alias("sum_cols"), r6(F.sum("reward")).alias("sum_reward"))
SQL["meta_load"] = BASE + """ select model model_key, count(*) n, sum(n_rows)::bigint sum_rows, sum(n_cols)::bigint sum_cols, round(sum(round(reward,6)),6) sum_reward
 from runs where seq%29<>0 group by 1"""

QUERIES["best_model_for_size"] = lambda s, d: R.best_model_for_size(dataset_profiles(s, d), logs.load_meta(s, written(meta_lines(s, d))))
SQL["best_model_for_size"] = BASE + PROFILES_SQL + """, lines as (select n_rows, model, round(reward,6) reward from runs where seq%29<>0),
 simi as (select p.dataset, h.model, avg(h.reward) mr from prof p join lines h on h.n_rows*1.0/greatest(p.n_rows,1) between 0.5 and 2.0 group by all)
 select p.dataset, case when (select count(*) from lines)>=3 then s.model end model
 from prof p left join (select * from simi qualify row_number() over (partition by dataset order by mr desc, model)=1) s on p.dataset=s.dataset"""
