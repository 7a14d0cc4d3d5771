"""Registered queries: what-if levers on the scored customer table.

The exact SQL twins score with the closed-form stand-in
(:func:`custspark.operators.whatif.linear_scorer`); the learner-backed
scenario is registered separately without a twin.
"""

from __future__ import annotations


from ..operators import whatif as wi
from . import customer360 as c360
from .catalog import query, round_doubles

SCENARIO = wi.Levers(cashback=10, support=20, price=5, subscription=30)


def _lit(x: float) -> str:
    return f"cast({float(x)!r} as double)"


def _rr(expr: str) -> str:
    return f"cast(round_even({expr}, 0) as bigint)"


def _d(c: str) -> str:
    return f"cast({c} as double)"


def _cashback_sql(src: str, c: float) -> str:
    rep = [f"{_rr(f'greatest({_d('Average_Cash_Back')} * {_lit(1 + c / 100)}, 0)')} as Average_Cash_Back"]
    if c > 0:
        rep += [f"{_rr(f'least({_d('Satisfaction_Score')} + {_lit(c * 0.05)}, 5)')} as Satisfaction_Score",
                f"{_rr(f'{_d('Loyalty_Engagement_Score')} + {_lit(c * 0.03)}')} as Loyalty_Engagement_Score",
                f"{_rr(f'greatest({_d('Days_Since_Last_Order')} * {_lit(1 - min(c * 0.04, 0.6))}, 0)')} as Days_Since_Last_Order"]
    else:
        rep += [f"{_rr(f'greatest({_d('Satisfaction_Score')} - {_lit(abs(c) * 0.04)}, 1)')} as Satisfaction_Score",
                f"{_rr(f'greatest({_d('Loyalty_Engagement_Score')} - {_lit(abs(c) * 0.025)}, 0)')} as Loyalty_Engagement_Score",
                f"{_rr(f'{_d('Days_Since_Last_Order')} * {_lit(1 + min(abs(c) * 0.03, 0.4))}')} as Days_Since_Last_Order"]
    return f"select * replace ({', '.join(rep)}) from {src}"


def _support_sql(src: str, s: float) -> str:
    rep = [f"{_rr(f'greatest({_d('Complain_Count_In_Last_Month')} * {_lit(1 - s / 100)}, 0)')} as Complain_Count_In_Last_Month",
           f"{_rr(f'least({_d('Satisfaction_Score')} + {_lit(s * 0.04)}, 5)')} as Satisfaction_Score",
           f"{_rr(f'{_d('Loyalty_Engagement_Score')} + {_lit(s * 0.025)}')} as Loyalty_Engagement_Score",
           f"{_rr(f'greatest({_d('Days_Since_Last_Order')} * {_lit(1 - min(s * 0.02, 0.3))}, 0)')} as Days_Since_Last_Order"]
    return f"select * replace ({', '.join(rep)}) from {src}"


def _price_sql(src: str, p: float) -> str:
    rep = [f"{_rr(f'greatest({_d('Total_Amount_Spent')} * {_lit(1 + p / 100)}, 0)')} as Total_Amount_Spent"]
    if p > 0:
        rep += [f"{_rr(f'{_d('Order_Amount_Hike_From_Last_Year')} + {_lit(p * 0.5)}')} as Order_Amount_Hike_From_Last_Year",
                f"{_rr(f'{_d('Days_Since_Last_Order')} * {_lit(1 + min(p * 0.08, 0.7))}')} as Days_Since_Last_Order",
                f"{_rr(f'greatest({_d('Satisfaction_Score')} - {_lit(p * 0.03)}, 1)')} as Satisfaction_Score",
                f"{_rr(f'greatest({_d('Loyalty_Engagement_Score')} - {_lit(p * 0.02)}, 0)')} as Loyalty_Engagement_Score"]
    else:
        rep += [f"{_rr(f'greatest({_d('Days_Since_Last_Order')} * {_lit(1 - min(abs(p) * 0.05, 0.4))}, 0)')} as Days_Since_Last_Order",
                f"{_rr(f'least({_d('Satisfaction_Score')} + {_lit(abs(p) * 0.02)}, 5)')} as Satisfaction_Score",
                f"{_rr(f'{_d('Loyalty_Engagement_Score')} + {_lit(abs(p) * 0.015)}')} as Loyalty_Engagement_Score"]
    return f"select * replace ({', '.join(rep)}) from {src}"


_ONE = "coalesce(trim(cast({c} as varchar)) = '1', false)"


def _subscription_sql(src: str, u: float, original: str = "a_customer360") -> str:
    one = _ONE.format(c="Total_Subscriptions")
    return f"""(with s0 as (select * from {src}),
elig as (select count(*) filter (where {one}) as e from s0),
rep as (select coalesce(min(cast(Total_Subscriptions as varchar)) filter (where not {one}), 'More than 1') as r from {original}),
rk as (select Customer_ID, row_number() over (order by md5(cast(Customer_ID as varchar)), Customer_ID) as rn from s0 where {one}),
s1 as (select s0.* replace (case when rk.rn is not null and rk.rn <= least(floor(cast(elig.e as double) * {_lit(u / 100)}), elig.e)
                                 then rep.r else cast(s0.Total_Subscriptions as varchar) end as Total_Subscriptions)
       from s0 left join rk on s0.Customer_ID = rk.Customer_ID, elig, rep)
select * replace (
  {_rr(f"case when not {one} then {_d('Loyalty_Engagement_Score')} + {_lit(u * 0.03)} else {_d('Loyalty_Engagement_Score')} end")} as Loyalty_Engagement_Score,
  {_rr(f"least({_d('Satisfaction_Score')} + {_lit(u * 0.02)}, 5)")} as Satisfaction_Score) from s1)"""


def _scenario_sql(lv: wi.Levers, src: str = "a_customer360") -> str:
    q = src
    if lv.cashback != 0:
        q = f"({_cashback_sql(q, lv.cashback)})"
    if lv.support > 0:
        q = f"({_support_sql(q, lv.support)})"
    if lv.price != 0:
        q = f"({_price_sql(q, lv.price)})"
    if lv.subscription > 0:
        q = _subscription_sql(q, lv.subscription)
    return q


def _score_sql(src: str) -> str:
    p = (f"least(greatest(0.15 + 0.2 * {_d('Complain_Count_In_Last_Month')} + 0.001 * {_d('Days_Since_Last_Order')}"
         f" - 0.05 * {_d('Satisfaction_Score')} - 0.001 * {_d('Average_Cash_Back')}, 0.0), 1.0)")
    v = (f"0.05 * {_d('Total_Amount_Spent')} + 0.5 * {_d('Loyalty_Engagement_Score')}"
         f" + case when {_ONE.format(c='Total_Subscriptions')} then 0.0 else 500.0 end")
    return f"select *, cast(({p}) > 0.5 as double) as _churn, {v} as _cltv from {src}"


def _base(t):
    return wi.with_baseline(c360.customer_360_materialized(t), wi.linear_scorer)


_LEVER_COLS = {
    "lever_cashback": (wi.Levers(cashback=10), ["Average_Cash_Back", "Satisfaction_Score",
                                                 "Loyalty_Engagement_Score", "Days_Since_Last_Order"]),
    "lever_cashback_cut": (wi.Levers(cashback=-15), ["Average_Cash_Back", "Satisfaction_Score",
                                                      "Loyalty_Engagement_Score", "Days_Since_Last_Order"]),
    "lever_support": (wi.Levers(support=20), ["Complain_Count_In_Last_Month", "Satisfaction_Score",
                                               "Loyalty_Engagement_Score", "Days_Since_Last_Order"]),
    "lever_price": (wi.Levers(price=10), ["Total_Amount_Spent", "Order_Amount_Hike_From_Last_Year",
                                           "Days_Since_Last_Order", "Satisfaction_Score", "Loyalty_Engagement_Score"]),
    "lever_price_cut": (wi.Levers(price=-5), ["Total_Amount_Spent", "Days_Since_Last_Order",
                                               "Satisfaction_Score", "Loyalty_Engagement_Score"]),
    "lever_subscription": (wi.Levers(subscription=30), ["Total_Subscriptions", "Loyalty_Engagement_Score",
                                                         "Satisfaction_Score"]),
}


def _register_lever(name, levers, cols):
    sql = f"select Customer_ID, {', '.join(cols)} from {_scenario_sql(levers)}"

    @query(name, sql=sql)
    def run(t):
        return wi.apply_levers(c360.customer_360_materialized(t), levers).select("Customer_ID", *cols)
    run.__doc__ = f"C1-C4: lever {levers} applied to the customer table."
    return run


for _name, (_lv, _cols) in _LEVER_COLS.items():
    _register_lever(_name, _lv, _cols)


_SIM_SQL = f"""with base as ({_score_sql('a_customer360')}),
sim as ({_score_sql(_scenario_sql(SCENARIO))})
select sim.Customer_ID, sim._churn as Simulated_Churn, round(sim._cltv, 6) as Simulated_CLTV,
  base._churn as Baseline_Churn, round(base._cltv, 6) as Baseline_CLTV
from sim join base on sim.Customer_ID = base.Customer_ID"""


@query("whatif_scenario", sql=_SIM_SQL)
def whatif_scenario(t):
    """All four levers, re-scored; simulated next to baseline."""
    sim = wi.simulate(_base(t), SCENARIO, wi.linear_scorer)
    return round_doubles(sim.select("Customer_ID", "Simulated_Churn", "Simulated_CLTV", "Baseline_Churn",
                                    "Baseline_CLTV"), 6)


_KPI_SQL = f"""with s as ({_SIM_SQL.replace('round(sim._cltv, 6)', 'sim._cltv').replace('round(base._cltv, 6)', 'base._cltv')}),
k as (select count(*) as customers, avg(Baseline_CLTV) as base_cltv_mean, avg(Baseline_Churn) * 100 as base_churn_pct,
  sum(Baseline_CLTV) as base_revenue, cast(sum(Baseline_Churn) as bigint) as base_churn_count,
  avg(Simulated_CLTV) as sim_cltv_mean, avg(Simulated_Churn) * 100 as sim_churn_pct, sum(Simulated_CLTV) as sim_revenue,
  cast(sum(Simulated_Churn) as bigint) as sim_churn_count,
  avg(case when Simulated_CLTV > Baseline_CLTV then 1.0 else 0.0 end) * 100 as improved_pct,
  count(*) filter (where Simulated_CLTV > Baseline_CLTV) as improved_count,
  count(*) filter (where Simulated_CLTV < Baseline_CLTV) as worsened_count from s)"""

_KPI_DOUBLES = ["base_cltv_mean", "base_churn_pct", "base_revenue", "sim_cltv_mean", "sim_churn_pct",
                "sim_revenue", "improved_pct", "avg_cltv_change", "revenue_diff"]


@query("whatif_kpis", sql=_KPI_SQL + " select * replace (" + ", ".join(
    f"round({c}, 4) as {c}" for c in _KPI_DOUBLES[:7]) +
    "), round(sim_cltv_mean - base_cltv_mean, 4) as avg_cltv_change, round(sim_revenue - base_revenue, 4) as revenue_diff,"
    " sim_churn_count - base_churn_count as churn_diff,"
    " round(case when base_cltv_mean = 0 then 0.0 else (sim_cltv_mean - base_cltv_mean) / base_cltv_mean * 100 end, 4)"
    " as cltv_change_pct,"
    " round(case when base_revenue = 0 then 0.0 else (sim_revenue - base_revenue) / base_revenue * 100 end, 4)"
    " as revenue_change_pct from k")
def whatif_kpis(t):
    """before/after KPIs of the scenario."""
    k = wi.whatif_kpis(wi.simulate(_base(t), SCENARIO, wi.linear_scorer))
    return round_doubles(k, 4)


_FIND_SQL = _KPI_SQL + """,
f as (select sim_churn_count - base_churn_count as cd, sim_revenue - base_revenue as rd,
        sim_cltv_mean - base_cltv_mean as acd, base_revenue as br from k),
conv as (select least(floor(cast(count(*) filter (where coalesce(trim(cast(Total_Subscriptions as varchar)) = '1', false)) as double) * {u}),
                      count(*) filter (where coalesce(trim(cast(Total_Subscriptions as varchar)) = '1', false))) as n from a_customer360),
rows as (
  select 1 as ord, case when cd < 0 then 'positive' when cd > 0 then 'negative' else 'neutral' end as severity,
         case when cd < 0 then 'CHURN_DOWN' when cd > 0 then 'CHURN_UP' else 'CHURN_SAME' end as code, true as fires, cast(cd as double) as figure from f
  union all select 2, case when rd > 0 then 'positive' when rd < 0 then 'negative' else 'neutral' end,
         case when rd > 0 then 'REVENUE_UP' when rd < 0 then 'REVENUE_DOWN' else 'REVENUE_SAME' end, true,
         case when br <> 0 then rd / br * 100 else 0.0 end from f
  union all select 3, case when acd > 0 then 'positive' else 'negative' end, 'AVG_CLTV', abs(acd) > 0.01, acd from f
  union all select 4, 'note', 'CASHBACK_UP', {c} > 0 and cd < 0, {c} from f
  union all select 4, 'note', 'CASHBACK_CUT', {c} < 0, abs({c}) from f
  union all select 5, 'note', 'SUPPORT', {s} > 0 and cd <= 0, {s} from f
  union all select 6, 'note', 'SUBSCRIPTION', {u0} > 0 and conv.n > 0, conv.n from f, conv
  union all select 7, 'note', 'MARKETING_UP', {p} > 0 and rd > 0, {p} from f
  union all select 7, 'note', 'MARKETING_CUT', {p} < 0, abs({p}) from f
  union all select 8, 'positive', 'OVERALL_GOOD', rd > 0 and cd <= 0, rd from f
  union all select 8, 'negative', 'OVERALL_BAD', rd < 0 and cd > 0, rd from f
  union all select 8, 'mixed', 'OVERALL_MIXED_REVENUE_UP', rd > 0 and cd > 0, rd from f
  union all select 8, 'mixed', 'OVERALL_MIXED_REVENUE_DOWN', rd < 0 and cd < 0, rd from f)
select ord, severity, code, round(cast(figure as double), 4) as figure from rows where fires"""


@query("whatif_findings", sql=_FIND_SQL.format(
    c=_lit(SCENARIO.cashback), s=_lit(SCENARIO.support), p=_lit(SCENARIO.price), u=_lit(SCENARIO.subscription / 100),
    u0=_lit(SCENARIO.subscription)))
def whatif_findings(t):
    """Rule-based findings of the scenario (codes and figures)."""
    base = _base(t)
    k = wi.whatif_kpis(wi.simulate(base, SCENARIO, wi.linear_scorer))
    return round_doubles(wi.whatif_findings(k, SCENARIO, base), 4)


@query("whatif_baseline", sql="""
select 1 as ord, 'neutral' as severity, 'BASELINE' as code, cast(null as double) as figure
from (select count(*) as customers from a_customer360)""")
def whatif_baseline(t):
    """All levers at 0 -> the baseline and its single finding."""
    base = _base(t)
    k = wi.whatif_kpis(wi.simulate(base, wi.Levers(), wi.linear_scorer))
    return wi.whatif_findings(k, wi.Levers(), base)
