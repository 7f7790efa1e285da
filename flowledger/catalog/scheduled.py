"""Cron and schedules (operators C11, E4, E6, G1, H10, J1-J9)."""

from pyspark.sql import functions as F

from flowledger.catalog.core import query
from flowledger.catalog.filters import paused_jobs
from flowledger.catalog.sqltext import EFFECTIVE, state
from flowledger.functions import cron
from flowledger.functions.times import literal_time
from flowledger.operators import filters, joins, schedules
from flowledger.plans import tick, timeline

# Whether a schedule of each kind fires at minute t, written out per kind instead of parsed.
_LOCAL = """timezone(case s.kind when 2 then 'America/New_York' when 7 then 'Asia/Kolkata' else 'UTC' end,
            timezone('UTC', t))"""
FIRES = f"""(case s.kind
    when 0 then minute({_LOCAL}) % (2 + s.v % 28) = 0
    when 1 then minute({_LOCAL}) = s.v % 60
    when 2 then minute({_LOCAL}) = s.v % 60 and hour({_LOCAL}) = s.v % 24 and dayofweek({_LOCAL}) between 1 and 5
    when 3 then minute({_LOCAL}) = 0 and hour({_LOCAL}) = 0
                and (day({_LOCAL}) in (1, 15) or dayofweek({_LOCAL}) = s.v % 7)
    when 4 then true
    when 7 then minute({_LOCAL}) = s.v % 60 and hour({_LOCAL}) = 6
    when 8 then minute({_LOCAL}) = 0 and case s.v % 5 when 1 then true else hour({_LOCAL}) = 0 and case s.v % 5
         when 0 then true when 2 then dayofweek({_LOCAL}) = 0 when 3 then day({_LOCAL}) = 1
         else day({_LOCAL}) = 1 and month({_LOCAL}) = 1 end end
    when 9 then minute({_LOCAL}) = 0 and hour({_LOCAL}) = 0 and day({_LOCAL}) = 1 + s.v % 28
    else false end)"""


def _ticks_sql(start: str, end: str) -> str:
    return f"""select s.job_key, s.schedule_key, t as tick
        from @schedules s, generate_series(timestamp '{start}' + interval 1 minute, timestamp '{end}', interval 1 minute) g(t)
        where {FIRES}"""


MONTH = ("2024-03-01 00:00:00", "2024-03-31 00:00:00")

_PAD = "lpad(cast({} as varchar), 2, '0')"
query(
    "H10_schedule_key",
    f"""select schedule_key, cron_expr, case kind
          when 0 then 'every_' || (2 + v % 28) || '_minutes'
          when 1 then case when v % 60 = 0 then 'hourly' else 'hourly_at_' || {_PAD.format('v % 60')} end
          when 2 then 'cron_' || v % 60 || '_' || v % 24 || '_mon_fri'
          when 3 then 'cron_0_0_1_15_' || v % 7
          when 4 then 'every_minute'
          when 5 then 'cron_' || v % 60 || '_' || v % 24 || '_5_7'
          when 6 then 'cron_' || v % 60 || '_6'
          when 7 then 'daily_at_06_' || {_PAD.format('v % 60')}
          when 8 then substr(cron_expr, 2)
          else case when v % 28 = 0 then 'monthly' else 'monthly_on_' || (1 + v % 28) || '_at_00_00' end end as inferred
        from @schedules""",
)(lambda h: h.schedules.select("schedule_key", "cron_expr", cron.schedule_key(F.col("cron_expr")).alias("inferred")))

query(
    "J1_cron_fields",
    """with a as (select *, array_to_string(range(60), ',') as m, array_to_string(range(24), ',') as h,
                        array_to_string(range(1, 32), ',') as d, array_to_string(range(1, 13), ',') as mo,
                        array_to_string(range(7), ',') as w from @schedules)
       select schedule_key, kind not in (5, 6) as valid,
         case kind when 0 then array_to_string(range(0, 60, 2 + v % 28), ',') when 1 then cast(v % 60 as varchar)
              when 2 then cast(v % 60 as varchar) when 4 then m when 7 then cast(v % 60 as varchar)
              when 5 then null when 6 then null else '0' end as minutes,
         case when kind in (0, 1, 4) or (kind = 8 and v % 5 = 1) then h when kind = 2 then cast(v % 24 as varchar)
              when kind = 7 then '6' when kind in (5, 6) then null else '0' end as hours,
         case when kind = 3 then '1,15' when kind = 8 and v % 5 in (3, 4) then '1' when kind = 9 then cast(1 + v % 28 as varchar)
              when kind in (5, 6) then null else d end as doms,
         case when kind = 8 and v % 5 = 4 then '1' when kind in (5, 6) then null else mo end as months,
         case when kind = 2 then '1,2,3,4,5' when kind = 3 then cast(v % 7 as varchar) when kind = 8 and v % 5 = 2 then '0'
              when kind in (5, 6) then null else w end as dows
       from a""",
)(
    lambda h: h.schedules.select("schedule_key", cron.cron_spec(F.col("cron_expr")).alias("s")).select(
        "schedule_key",
        "s.valid",
        *[
            F.when(F.col("s.valid"), F.array_join(F.col(f"s.{c}"), ",")).alias(f"{c}s")
            for c in ("minute", "hour", "dom", "month", "dow")
        ],
    )
)
query(
    "J2_cron_matches_runs",
    f"""select r.id, s.schedule_key from (select *, queued_at as t from @runs) r
        join (select id as job_id, job_key from @jobs) j on j.job_id = r.job_id
        join @schedules s on s.job_key = j.job_key where s.kind not in (5, 6) and {FIRES}""",
)(
    lambda h: schedules.matching_schedules(
        joins.runs_with_jobs(h.runs, h.stored("jobs").jobs).select("id", "job_key", "queued_at"), h.schedules, "queued_at"
    ).select("id", "schedule_key")
)
query(
    "J3_local_parts",
    """with x as (select e.event_id, e.ts, s.schedule_key,
                        case s.kind when 2 then 'America/New_York' when 7 then 'Asia/Kolkata' else 'UTC' end as zone,
                        s.timezone <> 'Mars/Olympus' as known
                 from @events e join @schedules s on s.sort_index = e.event_id % (select count(*) from @schedules)),
          p as (select *, timezone(zone, timezone('UTC', ts)) as l from x)
       select event_id, schedule_key, known, minute(l) as minute, hour(l) as hour, day(l) as dom, month(l) as month,
              dayofweek(l) as dow from p""",
)(
    lambda h: h.events.withColumn("sort_index", F.col("event_id") % h.schedules.agg(F.count(F.lit(1))).scalar())
    .join(h.schedules, "sort_index")
    .withColumn("l", cron.local_time(F.col("ts").cast("timestamp"), cron.zone_or_utc(F.col("timezone"))))
    .select(
        "event_id",
        "schedule_key",
        cron.zone_known(F.col("timezone")).alias("known"),
        F.minute("l").cast("long").alias("minute"),
        F.hour("l").cast("long").alias("hour"),
        F.dayofmonth("l").cast("long").alias("dom"),
        F.month("l").cast("long").alias("month"),
        (F.dayofweek("l") - 1).cast("long").alias("dow"),
    )
)
query("J4_occurrences", _ticks_sql(*MONTH))(
    lambda h: schedules.occurrences(h.schedules, literal_time(MONTH[0]), literal_time(MONTH[1]))
)
query(
    "E4_capped_occurrences",
    f"""with t as ({_ticks_sql(*MONTH)})
        select job_key, schedule_key, tick from
        (select *, row_number() over (partition by job_key, schedule_key order by tick) as rn from t) x where rn <= 720""",
)(
    lambda h: schedules.occurrences(
        h.schedules, literal_time(MONTH[0]), literal_time(MONTH[1]), cap=schedules.MAX_MARKERS
    )
)

# Key resolution: no explicit key of the derived declarations collides with an inferred one.
query(
    "E6_resolved_keys",
    """with k as (select job_key, sort_index, cron_expr, kind, v, sort_index % 3 = 0 as explicit, case kind
          when 0 then 'every_' || (2 + v % 28) || '_minutes'
          when 1 then case when v % 60 = 0 then 'hourly' else 'hourly_at_' || lpad(cast(v % 60 as varchar), 2, '0') end
          when 2 then 'cron_' || v % 60 || '_' || v % 24 || '_mon_fri'
          when 3 then 'cron_0_0_1_15_' || v % 7
          when 4 then 'every_minute'
          when 5 then 'cron_' || v % 60 || '_' || v % 24 || '_5_7'
          when 6 then 'cron_' || v % 60 || '_6'
          when 7 then 'daily_at_06_' || lpad(cast(v % 60 as varchar), 2, '0')
          when 8 then substr(cron_expr, 2)
          else case when v % 28 = 0 then 'monthly' else 'monthly_on_' || (1 + v % 28) || '_at_00_00' end end as base
        from @schedules),
       r as (select *, row_number() over (partition by job_key, base, explicit order by sort_index) as place from k)
       select job_key, sort_index, case when explicit then 'explicit_' || sort_index when place = 1 then base
              else base || '_' || place end as schedule_key from r""",
)(lambda h: schedules.resolved_keys(h.schedule_defs).select("job_key", "sort_index", "schedule_key"))



def _crowded_job(h):
    """One job over all customers with one expression: every other one has an explicit key, 20 numbers ahead of its place."""
    place = F.col("c_custkey") + 1
    return h.customer.select(
        F.lit("crowded").alias("job_key"),
        F.when(place % 2 == 0, F.concat(F.lit("hourly_"), place + 20)).otherwise(F.lit("")).alias("schedule_key"),
        F.lit("0 * * * *").alias("cron_expr"),
        place.alias("sort_index"),
    )


# The rth row without a key finds every other number from 22 on taken.
query(
    "E6_resolved_keys_of_a_crowded_job",
    """with p as (select c_custkey + 1 as sort_index from @customer),
       r as (select sort_index, case when sort_index % 2 = 1 then (sort_index + 1) // 2 end as r from p)
       select 'crowded' as job_key, sort_index,
              case when r is null then 'hourly_' || (sort_index + 20) when r = 1 then 'hourly'
                   when r <= 21 then 'hourly_' || r else 'hourly_' || (2 * r - 21) end as schedule_key from r""",
)(lambda h: schedules.resolved_keys(_crowded_job(h)).select("job_key", "sort_index", "schedule_key"))

NOW = "2024-01-10 12:00:02"


def active(h):
    return filters.enabled_schedules(h.schedules, paused_jobs(h))


_ACTIVE_SQL = "(select * from @schedules where is_enabled and job_key not in (select job_key from @jobs where id = 5))"
_DUE_SQL = f"""
    select s.job_key, s.schedule_key, g.t as tick from {_ACTIVE_SQL} s
    left join @schedule_state x on x.job_key = s.job_key and x.schedule_key = s.schedule_key,
    (select timestamp '2024-01-10 12:00:00' as t) g
    where s.timezone <> 'Mars/Olympus' and coalesce(x.last_enqueued_at, timestamp '2000-01-01') < g.t and {FIRES}"""
query("J5_due_ticks", _DUE_SQL)(lambda h: schedules.due_ticks(active(h), h.schedule_state, literal_time(NOW)))
NEXT_SQL = f"""
    with g as (select unnest(generate_series(timestamp '2024-01-10 12:01:00', timestamp '2024-01-18 00:00:00', interval 1 minute)) as t
               union select unnest(generate_series(timestamp '2024-01-10 13:00:00', timestamp '2025-02-01 00:00:00', interval 1 hour)))
    select s.job_key, s.schedule_key, min(g.t) as next_run_at from {_ACTIVE_SQL} s, g
    where s.timezone <> 'Mars/Olympus' and {FIRES} group by 1, 2"""
query("J5_next_runs", NEXT_SQL)(
    lambda h: schedules.next_runs(
        active(h), schedules.due_ticks(active(h), h.schedule_state, literal_time(NOW)), literal_time(NOW)
    )
)


def _tick(h):
    # One job is unknown to the tick, and one has no steps: neither can start a run.
    return tick.scheduler_tick(
        active(h), h.schedule_state, h.schedule_claims, h.jobs.filter("id <> 4"), h.job_nodes.filter("job_id <> 2"),
        literal_time(NOW), scheduler="main",
    )


_STARTABLE_SQL = "(select job_key from @jobs where id not in (2, 4) and id in (select job_id from @job_nodes))"
_WON_SQL = f"""
    with due as ({_DUE_SQL}),
    kept as (select c.* from @schedule_claims c join {_ACTIVE_SQL} s using (job_key, schedule_key))
    select d.job_key, d.schedule_key, d.tick as scheduled_for, 'scheduler:' || d.schedule_key as triggered_by,
           'run_' || sha256(d.job_key || chr(0) || d.schedule_key || chr(0) || strftime(d.tick, '%Y-%m-%dT%H:%M:%SZ')) as run_key
    from due d where not exists (select 1 from kept c where c.job_key = d.job_key and c.schedule_key = d.schedule_key
                                 and c.scheduled_for = d.tick)
    and d.job_key in {_STARTABLE_SQL}"""
query("J6_claims_won", _WON_SQL)(lambda h: _tick(h).won)
query(
    "J7_scheduled_runs",
    f"""with w as ({_WON_SQL})
        select w.run_key, j.id as job_id, 'queued' as status, w.triggered_by,
               '{{"schedule_key":"' || w.schedule_key || '","scheduled_for":"2024-01-10T12:00:00Z","scheduler_key":"main"}}'
                   as params_json,
               timestamp '{NOW}' as queued_at, cast(0 as bigint) as parent_run_id, '' as rerun_step_key, '' as error_message
        from w join @jobs j on j.job_key = w.job_key where j.id in (select job_id from @job_nodes)""",
)(lambda h: _tick(h).queued.runs)
query(
    "J7_scheduled_events",
    f"""with w as ({_WON_SQL})
        select w.run_key, '' as step_key, 'run_queued' as event_type, 'info' as level, 'run queued' as message,
               '{{"parent_run_id":"0","rerun_step_key":"","schedule_key":"' || w.schedule_key
               || '","scheduled_for":"2024-01-10T12:00:00Z","triggered_by":"' || w.triggered_by || '"}}' as event_data_json
        from w join @jobs j on j.job_key = w.job_key where j.id in (select job_id from @job_nodes)""",
)(lambda h: _tick(h).queued.events)
query(
    "J8_schedule_state",
    f"""with won as ({_WON_SQL}), nxt as ({NEXT_SQL})
        select s.job_key, s.schedule_key, timestamp '{NOW}' as last_checked_at,
               coalesce(w.scheduled_for, x.last_enqueued_at) as last_enqueued_at, n.next_run_at
        from {_ACTIVE_SQL} s
        left join @schedule_state x on x.job_key = s.job_key and x.schedule_key = s.schedule_key
        left join won w on w.job_key = s.job_key and w.schedule_key = s.schedule_key
        left join nxt n on n.job_key = s.job_key and n.schedule_key = s.schedule_key""",
)(lambda h: _tick(h).state)
query(
    "J8_schedule_errors",
    f"""select job_key, schedule_key, case when timezone = 'Mars/Olympus' then 'invalid timezone ' || timezone
               else 'invalid cron expression ' || cron_expr end as error
        from {_ACTIVE_SQL} s where timezone = 'Mars/Olympus' or kind in (5, 6)
        union all
        select job_key, schedule_key, 'no run can be created for job ' || job_key as error
        from ({_DUE_SQL}) d where job_key not in {_STARTABLE_SQL}""",
)(lambda h: _tick(h).errors.select("job_key", "schedule_key", "error"))

_TL = ("2000-01-01 00:00:00", "1999-12-01 00:00:00", "2000-02-01 00:00:00")
_RUN_TS = f"""case when lower(trim(r.triggered_by)) like 'scheduler:%' then date_trunc('minute', {EFFECTIVE})
              else {EFFECTIVE} end"""
_MARKERS_SQL = f"""
    with t as ({_ticks_sql(_TL[0], _TL[2])}),
    busy as (select distinct j.job_key, date_trunc('minute', {_RUN_TS}) as minute
             from @runs r join @jobs j on j.id = r.job_id)
    select * from t where not exists (select 1 from busy b where b.job_key = t.job_key and b.minute = t.tick)"""


def _with_jobs(h):
    return joins.runs_with_jobs(h.runs, h.jobs)


query("C11_unoccupied_ticks", _MARKERS_SQL)(
    lambda h: joins.unoccupied_ticks(
        schedules.occurrences(h.schedules, literal_time(_TL[0]), literal_time(_TL[2])).withColumn("minute", F.col("tick")),
        timeline.occupied_minutes(_with_jobs(h), literal_time(_TL[0]), literal_time(_TL[2])),
    ).select("job_key", "schedule_key", "tick")
)
_ARTIFACTS_SQL = f"""
    select 'run-' || r.id as id, 'run' as kind, j.job_key, {state('r.status')} as state, {_RUN_TS} as ts,
           coalesce(r.started_at, r.queued_at) as start_at, r.completed_at as end_at,
           case when r.completed_at > coalesce(r.started_at, r.queued_at)
                then epoch_ms(r.completed_at) - epoch_ms(coalesce(r.started_at, r.queued_at)) else 0 end as duration_ms,
           r.run_key
    from @runs r join @jobs j on j.id = r.job_id"""
query("G1_run_artifacts", _ARTIFACTS_SQL)(lambda h: timeline.run_artifacts(_with_jobs(h)))


def _timeline_sql(markers: str) -> str:
    return f"""{_ARTIFACTS_SQL}
        union all
        select 'schedule-' || m.job_key || '-' || m.schedule_key || '-' || epoch_ms(m.tick), 'schedule', m.job_key,
               'will_run', m.tick, m.tick, m.tick, 0, '' from ({markers}) m"""


def _timeline(h, cap):
    return timeline.timeline(_with_jobs(h), h.schedules, *[literal_time(x) for x in _TL], cap=cap)


query("J9_timeline", _timeline_sql(_MARKERS_SQL))(lambda h: _timeline(h, None))
query(
    "J9_timeline_capped",
    _timeline_sql(
        _MARKERS_SQL.replace(
            "select * from t where",
            f"""select job_key, schedule_key, tick from
                (select *, row_number() over (partition by job_key, schedule_key order by tick) as nth from t) t
                where nth <= {schedules.MAX_MARKERS} and""",
        )
    ),
)(lambda h: _timeline(h, schedules.MAX_MARKERS))
