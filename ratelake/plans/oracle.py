"""The registered queries once more, as SQL over the same tables (DuckDB dialect)."""

from __future__ import annotations

from ratelake.plans.order_rates import FIRST_RUN, SECOND_RUN
from ratelake.plans.queries import HI, HI_3, LO, LO_3

# The labels written out, so that a wrong one in the operator shows.
WEEKDAY, WEEKEND = "Weekday", "Weekend"
PRESENT = "OK - Data Present"
WEEKEND_GAP = "Missing - Normal Weekend No-Publish"
WEEKDAY_GAP = "CRITICAL - Lost Data / Gap"

_TICKS = """
ticks as (
  select strftime(o_orderdate, '%Y-%m-%d') as "date", 1.0::double as base_amount,
         'USD' as base, n_name as target, sqrt(o_totalprice) as rate, o_orderkey as src_id,
         o_orderpriority as priority, o_orderstatus as status
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""

_RATES = (
    _TICKS
    + """,
rates as (
  select * exclude (rn) from (
    select *, row_number() over (partition by "date", base, target order by src_id) as rn
    from ticks where rate between 0.00001 and 500000.0) q
  where rn = 1)"""
)

_DIRTY = (
    _TICKS
    + """,
dirty as (
  select "date", base, src_id,
    case when status = 'P' and priority = '5-LOW' then null else target end as target,
    case when status <> 'P' then rate
         when priority = '1-URGENT' then null
         when priority = '2-HIGH' then 0.0
         when priority = '3-MEDIUM' then 500001.0
         when priority = '4-NOT SPECIFIED' and rate < 400 then 0.00001
         when priority = '4-NOT SPECIFIED' then 500000.0
         else rate end::double as rate
  from ticks)"""
)


def _snapshots(tombstones: bool = False) -> str:
    operation = "'INSERT'"
    if tombstones:
        operation = "case when status = 'P' then 'DELETE' else 'INSERT' end"
    return (
        _RATES
        + f""",
stored as (
  select "date", base_amount, base, target, rate, '{FIRST_RUN}' as ingested_at,
         sha256(rate::decimal(18,6)::varchar) as row_hash, {operation} as operation_type,
         '{FIRST_RUN}' as ingestion_timestamp, '{FIRST_RUN}' as updated_at
  from rates where priority <> '1-URGENT'),
incoming as (
  select * replace (rate::double as rate), sha256(rate::decimal(18,6)::varchar) as row_hash,
         '{SECOND_RUN}' as ingested_at
  from (select "date", base_amount, base, target,
               case when priority = '3-MEDIUM' then rate * 1.01::double else rate end as rate
        from rates where priority <> '2-HIGH') q)"""
    )


def _changes(
    tombstones: bool = False,
    strict: bool = False,
    within: tuple[str, str] | None = None,
    empty: bool = False,
) -> str:
    stored = "where operation_type <> 'DELETE'" if strict else "where true"
    new = "where false" if empty else "where true"
    if within:
        bounds = f""" and "date" between '{within[0]}' and '{within[1]}'"""
        stored, new = stored + bounds, new + bounds
    return (
        _snapshots(tombstones)
        + f""",
changes as (
  select * from (
    select coalesce(i."date", s."date") as "date",
           coalesce(i.base_amount, s.base_amount) as base_amount,
           coalesce(i.base, s.base) as base, coalesce(i.target, s.target) as target,
           coalesce(i.rate, s.rate) as rate,
           coalesce(i.ingested_at, s.ingested_at) as ingested_at,
           coalesce(i.row_hash, s.row_hash) as row_hash,
           case when s."date" is null then 'INSERT' when i."date" is null then 'DELETE'
                when i.row_hash <> s.row_hash then 'UPDATE' else 'NO_CHANGE' end as operation_type,
           '{SECOND_RUN}' as ingestion_timestamp, '{SECOND_RUN}' as updated_at
    from (select * from incoming {new}) i
    full outer join (select * from stored {stored}) s
      on i."date" = s."date" and i.base = s.base and i.target = s.target) q
  where operation_type <> 'NO_CHANGE')"""
    )


def _merged(revive: bool = False, **options) -> str:
    takes_all = """s."date" is null"""
    if revive:
        takes_all += " or (c.operation_type = 'INSERT' and s.operation_type = 'DELETE')"

    def column(name: str, operations: str = "") -> str:
        test = takes_all + (f" or c.operation_type in ({operations})" if operations else "")
        return f'case when {test} then c."{name}" else s."{name}" end as "{name}"'

    plain = ("date", "base", "target", "ingested_at", "ingestion_timestamp")
    on_update = ("base_amount", "rate", "row_hash")
    on_both = ("operation_type", "updated_at")
    columns = ", ".join(
        [column(name) for name in plain]
        + [column(name, "'UPDATE'") for name in on_update]
        + [column(name, "'UPDATE', 'DELETE'") for name in on_both]
    )
    return (
        _changes(strict=revive, **options)
        + f""",
merged as (
  select {columns} from stored s full outer join changes c
    on c."date" = s."date" and c.base = s.base and c.target = s.target)"""
    )


_CHANGE_VIEW = """ select "date", base, target, base_amount, round(rate, 6) as rate, row_hash,
  operation_type, ingested_at, updated_at from changes"""
_STORED_VIEW = """ select "date", base, target, base_amount, round(rate, 6) as rate, row_hash,
  operation_type, ingested_at, ingestion_timestamp, updated_at from merged"""


def _metrics(relation: str) -> str:
    return f"""
windows as (
  select *, lag(rate) over w as prev,
    avg(rate) over (w rows between 6 preceding and current row) as sma_7d,
    avg(rate) over (w rows between 29 preceding and current row) as sma_30d,
    coalesce(stddev_samp(rate) over (w rows between 29 preceding and current row), 0.0)
      as volatility_30d
  from {relation}
  window w as (partition by base, target order by "date")),
metrics as (
  select *, case when prev > 0 then (rate - prev) / prev * 100 else 0.0 end as daily_variation_pct
  from windows),
flagged as (
  select *, volatility_30d > 0 and abs(rate - sma_30d) > 2 * volatility_30d as is_anomaly,
    case when volatility_30d > 0 then round((rate - sma_30d) / volatility_30d, 2) + 0.0
         else 0.0 end as z_score
  from metrics)"""


_METRIC_VALUES = ", ".join(
    f"round({name}, 6) + 0.0 as {name}"
    for name in ("rate", "daily_variation_pct", "sma_7d", "sma_30d", "volatility_30d")
)


def _monthly(relation: str) -> str:
    return f""" select base, target, year("date"::date)::int as "year",
  month("date"::date)::int as "month", round(avg(rate), 4) as avg_rate,
  round(min(rate), 6) as min_rate, round(max(rate), 6) as max_rate,
  round(coalesce(stddev_samp(rate), 0.0), 4) + 0.0 as monthly_volatility,
  count(rate) as observations_count from {relation} group by all"""


def _calendar(by: str = "") -> str:
    same = "and c.base = s.base and c.target = s.target" if by else ""
    return f"""
seen as (select distinct {by} "date"::date as dq_date from rates),
bounds as (select {by} min(dq_date) as lo, max(dq_date) as hi from seen group by all),
calendar as (
  select {by} unnest(generate_series(lo, hi, interval 1 day))::date as dq_date from bounds),
days_seen as (
  select c.*, s.dq_date is null as is_missing, dayofweek(c.dq_date) in (0, 6) as weekend
  from calendar c left join seen s on c.dq_date = s.dq_date {same}),
report as (
  select {by} dq_date, is_missing,
    case when weekend then '{WEEKEND}' else '{WEEKDAY}' end as day_type,
    case when not is_missing then '{PRESENT}' when weekend then '{WEEKEND_GAP}'
         else '{WEEKDAY_GAP}' end as status_detail
  from days_seen)"""


def _coverage_totals(by: str = "") -> str:
    return f""" select {by} min(dq_date)::varchar as first_date, max(dq_date)::varchar as last_date,
  count(*) as total_days, count(*) filter (is_missing) as missing_days,
  count(*) filter (is_missing and day_type = '{WEEKDAY}') as missing_weekdays,
  count(*) filter (is_missing and day_type = '{WEEKEND}') as missing_weekends,
  round((count(*) - count(*) filter (is_missing)) / count(*) * 100, 2) as coverage_pct
  from report group by all"""


_REPORT_VIEW = " dq_date::varchar as dq_date, day_type, status_detail, is_missing from report"

_TRANSACTIONS = """
transactions as (
  select l_orderkey || '-' || l_linenumber as transaction_id,
    strftime(l_shipdate, '%Y-%m-%d') as "date", o_custkey as customer_id,
    n_name as target_currency, l_extendedprice as local_amount
  from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey)"""


def _converted(relation: str) -> str:
    return f""" select transaction_id, t."date", c_name as customer_name, c_mktsegment as segment,
  target_currency as source_currency, local_amount, round(rate, 6) as daily_rate,
  round(local_amount / rate, 2) as amount_in_usd
  from transactions t join customer on customer_id = c_custkey
  join {relation} r on t."date" = r."date" and target_currency = r.target"""


_IN_LO_HI = (LO, HI)
_SECOND_STAMP_EVENT = SECOND_RUN.replace(" ", "T") + "Z"

_EVENTS = f""" select operation_type as event_type, '{_SECOND_STAMP_EVENT}' as event_timestamp,
  base || '-' || target || '-' || "date" as entity_id, "date", base, target, base_amount,
  round(rate, 6) as rate, row_hash from changes"""

_FIRST_STAMP_EVENT = FIRST_RUN.replace(" ", "T") + "Z"

#: After the third batch: in its range the old rows again, but for those that the second
#: batch deleted, which stay deleted; in the rest of the second batch's range the new rows.
_THIRD = f""",
live as (
  select "date", base, target, rate from incoming
  where "date" between '{LO}' and '{HI}' and not "date" between '{LO_3}' and '{HI_3}'
  union all
  select "date", base, target, rate from stored where not "date" between '{LO}' and '{HI}'
  union all
  select "date", base, target, rate from rates
  where "date" between '{LO_3}' and '{HI_3}' and priority not in ('1-URGENT', '2-HIGH'))"""

#: The rows before each month of a pair, the last 29 of them.
_TAILS = """,
months as (
  select distinct base, target, substr("date", 1, 7) as m from live),
numbered as (
  select m.base, m.target, m.m, l."date", l.rate,
    row_number() over (partition by m.base, m.target, m.m order by l."date" desc) as nth
  from months m left join live l
    on l.base = m.base and l.target = m.target and l."date" < m.m || '-01')
select base, target, substr(m, 1, 4)::int as "year", substr(m, 6, 2)::int as "month",
  count("date")::int as row_count, min("date") as first_date, max("date") as last_date,
  round(coalesce(sum(rate), 0.0), 4) as rate_total
from numbered where nth <= 29 group by base, target, m"""

#: The changes of rates of four decimals, compared and hashed by their plain text.
_DEFAULT_HASH = (
    "with"
    + _changes()
    .replace("rate::decimal(18,6)::varchar", "round(rate, 4)::varchar")
    .replace("""select "date", base_amount, base, target, rate, '""", """select "date", base_amount, base, target, round(rate, 4) as rate, '""")
    .replace("replace (rate::double as rate)", "replace (round(rate, 4) as rate)")
)

_LIVE = """,
live as (select * from merged where operation_type <> 'DELETE')"""


def _second_calendar() -> str:
    """The report of the second batch, under names of its own."""
    text = _calendar().replace(
        "from rates", f"""from (select * from incoming where "date" between '{LO}' and '{HI}') i"""
    )
    for name in ("seen", "bounds", "calendar", "days_seen", "report"):
        text = text.replace(f"{name} as (", f"{name}_2 as (").replace(f"from {name} ", f"from {name}_2 ")
        text = text.replace(f"from {name})", f"from {name}_2)").replace(f"join {name} ", f"join {name}_2 ")
    return text


def statements() -> dict[str, str]:
    with_rates = "with" + _RATES
    both_batches = "with" + _merged(within=_IN_LO_HI)
    return {
        "clean_rates": with_rates
        + ' select "date", base, target, base_amount, round(rate, 6) as rate, src_id from rates',
        "clean_dirty_rates": "with"
        + _DIRTY
        + """ select "date", base, target, round(rate, 6) as rate, src_id from (
          select *, row_number() over (partition by "date", base, target order by src_id) as rn
          from dirty where rate between 0.00001 and 500000.0 and target is not null) q
          where rn = 1""",
        "clean_drop_report": "with"
        + _DIRTY
        + """,
        valid as (
          select * from dirty where target is not null and rate between 0.00001 and 500000.0),
        kept as (select count(*) as n from (select distinct "date", base, target from valid) q)
        select 'missing field' as rule, count(*) as row_count from dirty
          where target is null or rate is null
        union all select 'rate out of range', count(*) from dirty
          where target is not null and rate is not null and not rate between 0.00001 and 500000.0
        union all select 'duplicate key', (select count(*) from valid) - n from kept
        union all select 'kept', n from kept""",
        "date_range_filter": with_rates
        + f""" select "date", base, target, round(rate, 6) as rate from rates
          where "date" between '{LO}' and '{HI}'""",
        "flatten_documents": "with"
        + _TICKS
        + f""" select "date", base, target, 1.0::double as base_amount, round(min(rate), 6) as rate,
          '{FIRST_RUN}' as ingested_at from ticks group by "date", base, target""",
        "flatten_text_column": "with"
        + _TICKS
        + """ select base, target, count(*) as observations, count(distinct "date") as dates,
          min(rate) as min_rate, max(rate) as max_rate from ticks group by base, target""",
        "flatten_wide_documents": with_rates
        + f""" select "date", base_amount, target, '{FIRST_RUN}' as ingested_at,
          case when substr("date", 6, 2)::int % 2 = 1 then 'USD' else 'EUR' end as base,
          round(case when priority = '5-LOW' then floor(rate) else rate end, 6) as rate
          from rates""",
        "cdc_default_hash": _DEFAULT_HASH + _CHANGE_VIEW,
        "fact_rates_without_stamp": "with"
        + _changes()
        + """ select "date", base, target, round(rate, 6) as rate,
          ingested_at as ingestion_timestamp from changes where operation_type <> 'DELETE'""",
        "flatten_rejects": "with"
        + _TICKS
        + """, damaged as (
          select case when status <> 'P' then null when priority = '1-URGENT' then 'not a number'
              when priority = '2-HIGH' then 'no value'
              when priority = '3-MEDIUM' then 'unreadable document'
              when priority = '4-NOT SPECIFIED' then 'day without rates' end as problem, *
          from ticks)
          select problem,
            case when problem in ('not a number', 'no value') then target end as target,
            count(*) as rejects,
            count(distinct case when problem <> 'unreadable document' then "date" end) as dates
          from damaged where problem is not null group by 1, 2""",
        "flatten_latest_document": "with"
        + _TICKS
        + """ select "date", base, target, round(arg_max(rate, src_id), 6) as rate
          from ticks group by "date", base, target""",
        "cdc_changes": "with" + _changes() + _CHANGE_VIEW,
        "cdc_changes_in_range": "with" + _changes(within=_IN_LO_HI) + _CHANGE_VIEW,
        "cdc_changes_by_digest": "with" + _changes(within=_IN_LO_HI) + _CHANGE_VIEW,
        "month_digests": "with"
        + _snapshots(tombstones=True)
        + """, kinds as (
          select base, target, "date", false as live from stored union all
          select base, target, "date", true from stored where operation_type <> 'DELETE')
        select base, target, substr("date", 1, 4)::int as "year",
          substr("date", 6, 2)::int as "month", live, count(*) as n
        from kinds group by all""",
        "cdc_initial_load": with_rates
        + f""" select "date", base, target, base_amount, round(rate, 6) as rate,
          sha256(rate::decimal(18,6)::varchar) as row_hash, 'INSERT' as operation_type,
          '{FIRST_RUN}' as ingested_at, '{FIRST_RUN}' as updated_at from rates""",
        "cdc_empty_batch": "with" + _changes(within=_IN_LO_HI, empty=True) + _CHANGE_VIEW,
        "cdc_latched_tombstones": "with" + _changes(tombstones=True) + _CHANGE_VIEW,
        "cdc_strict_tombstones": "with" + _changes(tombstones=True, strict=True) + _CHANGE_VIEW,
        "cdc_op_counts": "with"
        + _changes()
        + " select operation_type, count(*) as row_count from changes group by operation_type",
        "delete_gate": "with"
        + _changes()
        + """ select count(*) filter (operation_type = 'DELETE') > 0 as has_deletes,
          count(*) filter (operation_type = 'DELETE') as delete_count from changes""",
        "merge_snapshot": "with" + _merged() + _STORED_VIEW,
        "merge_live_rows": "with"
        + _merged()
        + _LIVE
        + ' select "date", base, target, round(rate, 6) as rate, operation_type from live',
        "merge_tombstones": "with" + _merged(tombstones=True) + _STORED_VIEW,
        "merge_strict_revival": "with" + _merged(tombstones=True, revive=True) + _STORED_VIEW,
        "load_append": "with"
        + _snapshots()
        + """ select year("date"::date)::int as "year", month("date"::date)::int as "month", target,
          count(*) as row_count, round(sum(rate), 4) as rate_total
          from (select "date", target, rate from stored
                union all select "date", target, rate from incoming) q group by all""",
        "load_overwrite_partitions": "with"
        + _snapshots()
        + """ select "date", base, target, round(rate, 6) as rate,
          year("date"::date)::int as "year", month("date"::date)::int as "month"
          from (select "date", base, target, rate from stored
                where "date" not between '1997-04-01' and '1998-09-30'
                  or substr("date", 1, 7) not in (
                    select substr("date", 1, 7) from incoming
                    where "date" between '1997-04-01' and '1998-09-30')
                union all select "date", base, target, rate from incoming
                where "date" between '1997-04-01' and '1998-09-30') q""",
        "load_merge_cdc": both_batches
        + _STORED_VIEW.replace(
            "updated_at from",
            "updated_at, exists (select 1 from changes where operation_type = 'DELETE')"
            " as has_deletes from",
        ),
        "rolling_metrics": with_rates
        + ","
        + _metrics("rates")
        + f""" select "date", base, target, base_amount, '{FIRST_RUN}' as updated_at,
          {_METRIC_VALUES} from metrics""",
        "anomaly_flags": with_rates
        + ","
        + _metrics("rates")
        + f' select "date", base, target, {_METRIC_VALUES}, is_anomaly, z_score from flagged',
        "anomalies_only": with_rates
        + ","
        + _metrics("rates")
        + """ select "date", base, target, round(rate, 6) as rate, z_score
          from flagged where is_anomaly""",
        "monthly_summary": with_rates + _monthly("rates"),
        "monthly_summary_sorted": with_rates
        + _monthly("rates")
        + ' order by "year", "month", target',
        "coverage_report": with_rates + "," + _calendar() + " select" + _REPORT_VIEW,
        "coverage_summary": with_rates + "," + _calendar() + _coverage_totals(),
        "coverage_by_pair": with_rates
        + ","
        + _calendar("base, target,")
        + " select base, target,"
        + _REPORT_VIEW,
        "coverage_summary_by_pair": with_rates
        + ","
        + _calendar("base, target,")
        + _coverage_totals("base, target,"),
        "coverage_gaps": with_rates
        + ","
        + _calendar("base, target,")
        + " select base, target,"
        + _REPORT_VIEW
        + " where is_missing",
        "coverage_from_bitmaps": with_rates + "," + _calendar() + " select" + _REPORT_VIEW,
        "coverage_from_bitmaps_by_pair": with_rates
        + ","
        + _calendar("base, target,")
        + " select base, target,"
        + _REPORT_VIEW,
        "days_covered": with_rates
        + """ select base, target, count(distinct "date") as days from rates group by all""",
        "monthly_summary_merged": both_batches + _LIVE + _monthly("live"),
        "monthly_summary_of_inserts": with_rates + _monthly("rates"),
        "newest_dq_rows": with_rates
        + ","
        + _calendar()
        + " select"
        + _REPORT_VIEW
        + " order by report.dq_date desc limit 5",
        "dim_customer": "select c_custkey as customer_id, c_name as customer_name,"
        " c_mktsegment as segment from customer",
        "dim_currency": "select n_nationkey as currency_code, n_name as currency_name from nation",
        "fact_rates": "with"
        + _changes()
        + """ select "date", base, target, round(rate, 6) as rate, ingestion_timestamp
          from changes where operation_type <> 'DELETE'""",
        "fact_transactions": "with" + _TRANSACTIONS + " select * from transactions",
        "converted_transactions": with_rates + "," + _TRANSACTIONS + _converted("rates"),
        "converted_transactions_two_bases": with_rates
        + """, second as (
          select * replace (rate * 1.5 as rate) from rates where priority <> '5-LOW'),"""
        + _TRANSACTIONS
        + _converted("second"),
        "change_events": "with" + _changes() + _EVENTS,
        "change_events_json_roundtrip": "with" + _changes() + _EVENTS,
        "two_batches_base": both_batches
        + """ select "date", base, target, base_amount, round(rate, 6) as rate,
          operation_type, ingested_at, updated_at from merged""",
        "two_batches_enriched": both_batches
        + _LIVE
        + ","
        + _metrics("live")
        + f' select "date", base, target, {_METRIC_VALUES} from metrics',
        "three_batches_enriched": "with"
        + _snapshots()
        + _THIRD
        + ","
        + _metrics("live")
        + f' select "date", base, target, {_METRIC_VALUES} from metrics',
        "three_batches_tails": "with" + _snapshots() + _THIRD + _TAILS,
        "two_batches_changes_scope": "with"
        + _changes(within=_IN_LO_HI)
        + ","
        + _metrics("changes")
        + f' select "date", base, target, {_METRIC_VALUES} from metrics',
        "two_batches_quality": "with"
        + _snapshots()
        + ","
        + _calendar().replace("from rates", "from stored")
        + ","
        + _second_calendar()
        + f""" select '{FIRST_RUN}' as execution_timestamp, {_REPORT_VIEW}
          union all
          select '{SECOND_RUN}', {_REPORT_VIEW.replace("from report", "from report_2")}""",
        "two_batches_events": "with"
        + _changes(within=_IN_LO_HI)
        + f""" select operation_type as event_type, '{_SECOND_STAMP_EVENT}' as event_timestamp,
          base || '-' || target || '-' || "date" as entity_id, "date", base, target, base_amount,
          round(rate, 6) as rate from changes
          union all
          select 'INSERT', '{_FIRST_STAMP_EVENT}', base || '-' || target || '-' || "date",
          "date", base, target, base_amount, round(rate, 6) from stored""",
        "two_batches_anomalies": both_batches
        + _LIVE
        + ","
        + _metrics("live")
        + """ select "date", base, target, round(rate, 6) as rate, is_anomaly, z_score
          from flagged""",
        "two_batches_monthly": both_batches + _LIVE + _monthly("live"),
        "two_batches_report": both_batches
        + _LIVE
        + ","
        + _TRANSACTIONS
        + _converted("live")
        + f""" where t."date" between '{LO}' and '{HI}'""",
        "table_row_counts": both_batches
        + """,
        months as (
          select distinct base, target, substr("date", 1, 7) as m from stored),
        bounds as (select min("date"::date) as lo, max("date"::date) as hi from stored),
        counts as (
          select 'base' as table_name, (select count(*) from merged) as total
          union all select 'enriched', (select count(*) from stored)
          union all select 'monthly', (select count(*) from months)
          union all select 'anomalies', (select count(*) from stored)
          union all select 'quality', (select date_diff('day', lo, hi) + 1 from bounds))
        select *, 'base_only' as status from counts""",
    }
