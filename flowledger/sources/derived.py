"""History tables derived from the given parquet tables.

Each view is one SQL text, formatted for Spark or for the checking engine. All arithmetic is on
integers, so both agree exactly. Every view is a projection, an aggregate on its own key, or an
equi-join with a fan-out of at most three; none needs an ordered or unbounded group.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from flowledger.session import materialize

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")

# ``add_secs(ts, n)``, ``ts(x)``, ``idiv(a, b)`` and ``steps(1..3)`` are replaced per engine.
VIEWS: dict[str, str] = {
    "jobs": """
        select cast(left(p, 1) as bigint) as id, lower(replace(substr(p, 3), ' ', '_')) as job_key,
               case when left(p, 1) = '5' then '' else p end as display_name,
               '' as description, '{}' as default_params_json
        from (select distinct o_orderpriority as p from @orders) d
    """,
    "runs": """
        select id, concat('run_', id) as run_key, job_id, status, triggered_by,
               case when triggered_by like 'queue:%' then concat(
                    '{"workflow_queue":{"queue_key":"customer_imports","queue_item_id":', id,
                    ',"partition_key":"', case when id % 20 = 1 then '' else concat('cust_', o_custkey) end,
                    '","external_key":"ext_', id, '","payload":{"total":', cast(floor(o_totalprice) as bigint), '}}}')
                    else '{}' end as params_json,
               queued_at, started_at,
               case when k in (6, 7) then null
                    else add_secs(started_at, cast(floor(o_totalprice) as bigint) % 7200 - 60) end as completed_at,
               case when o_orderkey % 25 = 24 then o_orderkey else 0 end as parent_run_id,
               case when o_orderkey % 25 = 24 then 's3' else '' end as rerun_step_key,
               case when k in (5, 8) then concat('run ', id, ' failed') else '' end as error_message,
               queued_at as created_at
        from (select *, case when status = 'queued' then null
                             else add_secs(queued_at, o_custkey % 600) end as started_at
              from (select o_orderkey, o_custkey, o_totalprice, o_orderkey + 1 as id, o_orderkey % 10 as k,
                           cast(left(o_orderpriority, 1) as bigint) as job_id,
                           add_secs(ts(o_orderdate), o_orderkey * 37 % 86400) as queued_at,
                           case when o_orderkey % 10 <= 4 then 'success'
                                when o_orderkey % 10 = 5 then 'failed'
                                when o_orderkey % 10 = 6 and idiv(o_orderkey, 10) % 3 = 0 then 'queued'
                                when o_orderkey % 10 = 6 then 'running'
                                when o_orderkey % 10 = 7 then 'queued'
                                when o_orderkey % 10 = 8 then 'cancelled'
                                else ' SUCCESS ' end as status,
                           case o_custkey % 4 when 0 then 'manual' when 1 then 'scheduler:every_5_minutes'
                                when 2 then 'queue:customer_imports' else 'backfill:manual' end as triggered_by
                    from @orders) a) b
    """,
    "job_nodes": """
        select l_orderkey + 1 as job_id, concat('s', l_linenumber) as step_key,
               cast(l_linenumber as bigint) as sort_index, min(l_returnflag) as rf, min(l_linestatus) as ls,
               max(l_quantity) as q, max(l_extendedprice) as p, min(ts(l_shipdate)) as ship
        from @lineitem group by l_orderkey, l_linenumber
    """,
    "job_edges": """
        select a.job_id, a.step_key as from_step_key, b.step_key as to_step_key
        from (select *, steps() as gap from @job_nodes) a
        join @job_nodes b on b.job_id = a.job_id and b.sort_index = a.sort_index + a.gap
        where a.rf = b.rf or a.ls = b.ls
    """,
    "run_steps": """
        select run_id, step_key, sort_index, status, cast(1 as bigint) as attempt, started_at, duration_ms,
               case when status = 'success' then concat('{"v":', sort_index, '}') else '{}' end as output_json,
               case when status = 'failed' then concat('step ', step_key, ' failed') else '' end as error_message
        from (select job_id as run_id, step_key, sort_index,
                     case cast(q as bigint) % 6 when 3 then 'failed' when 4 then 'pending' when 5 then 'skipped'
                          else 'success' end as status,
                     case when cast(q as bigint) % 6 in (4, 5) then null else ship end as started_at,
                     case when cast(q as bigint) % 6 in (4, 5) then 0
                          else cast(round(p) as bigint) % 60000 end as duration_ms
              from @job_nodes) n
    """,
    "run_events": """
        select id, run_id, step_key, event_type,
               case when event_type = 'step_failed' then 'error' when event_id % 11 = 0 then 'Warning'
                    else 'info' end as level,
               concat(event_type, case event_id % 3 when 0 then ' stdout' when 1 then ' stderr' else '' end) as message,
               case when event_type = 'run_completed'
                    then case when event_id % 4 = 0 then '{"status": "failed"}' else '{"status": "success"}' end
                    else props end as event_data_json,
               created_at
        from (select event_id, event_id + 1 as id, user_id as run_id, props, ts(ts) as created_at,
                     case when event_type in ('signup', 'purchase') then ''
                          else concat('s', event_id % 7 + 1) end as step_key,
                     case event_type when 'signup' then 'run_started' when 'view' then 'step_started'
                          when 'click' then 'step_succeeded' when 'error' then 'step_failed'
                          else 'run_completed' end as event_type
              from @events) e
    """,
    "queues": """
        select id, queue_key, upper(queue_key) as display_name, '' as description,
               concat('/queues/', queue_key) as route_path,
               case when id % 2 = 1 then 'poll' else 'stream' end as load_mode,
               cast(case when id % 2 = 1 then 60 else 0 end as bigint) as load_poll_every_seconds
        from (select distinct event_type as queue_key,
                     cast(case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3
                          when 'signup' then 4 else 5 end as bigint) as id
              from @events) e
    """,
    "queue_jobs": """
        select id as queue_id, id as job_id, cast(0 as bigint) as sort_index from @queues
        union all
        select id as queue_id, id % 5 + 1 as job_id, cast(1 as bigint) as sort_index from @queues
    """,
    "queue_items": """
        select event_id + 1 as id,
               cast(case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3
                    when 'signup' then 4 else 5 end as bigint) as queue_id,
               concat('qit_', event_id + 1) as queue_item_key, concat('u', user_id) as partition_key,
               'queued' as status, concat('ext:', regexp_extract(props, '([0-9]+)', 1)) as external_key,
               props as payload_json, ts(ts) as queued_at, ts(ts) as created_at
        from @events
    """,
    "queue_item_runs": """
        select r.id as id, e.event_id + 1 as queue_item_id, r.job_id as job_id, r.id as run_id,
               add_secs(ts(e.ts), (r.id + 1) % 2) as created_at
        from @events e join @runs r on e.event_id = idiv(r.id - 1, 2)
    """,
    "queue_item_step_metadata": """
        select l.id as id, l.queue_item_id, l.run_id, 'publish' as step_key,
               case when l.id % 40 = 7 then cast(99 as bigint) else l.job_id end as job_id,
               case when (l.queue_item_id - 1) % 50 = 0 then 'not json'
                    else concat('{"k": ', regexp_extract(e.props, '([0-9]+)', 1), ', "run": ', l.run_id, '}')
                    end as metadata_json
        from @queue_item_runs l join @events e on e.event_id + 1 = l.queue_item_id
    """,
    # Settled items: stored status and end time as the lifecycle rollup would leave them.
    "settled_items": """
        select i.id, i.queue_id, i.partition_key, i.created_at,
               case i.id % 7 when 0 then 'queued' when 1 then 'running' when 2 then 'failed' when 3 then 'paused'
                    else 'complete' end as status,
               case when i.id % 7 in (0, 1, 3) then null
                    else add_secs(i.queued_at, i.id % 3600) end as completed_at
        from @queue_items i
    """,
    "schedules": """
        select job_key, concat('sched_', s_suppkey) as schedule_key, cron_expr, timezone, is_enabled,
               concat('runs ', cron_expr) as description, s_suppkey as sort_index, kind, v
        from (select s_suppkey, kind, v, s_suppkey % 11 <> 0 as is_enabled,
                     case s_suppkey % 5 when 0 then 'urgent' when 1 then 'high' when 2 then 'medium'
                          when 3 then 'not_specified' else 'low' end as job_key,
                     case kind when 0 then concat('*/', 2 + v % 28, ' * * * *')
                          when 1 then concat(v % 60, ' * * * *')
                          when 2 then concat(v % 60, ' ', v % 24, ' * * mon-fri')
                          when 3 then concat('0 0 1,15 * ', v % 7)
                          when 4 then '* * * * *'
                          when 5 then concat(v % 60, ' ', v % 24, ' * * 5-7')
                          when 6 then concat(v % 60, ' 6 *')
                          when 7 then concat(v % 60, ' 6 * * *')
                          when 8 then case v % 5 when 0 then '@daily' when 1 then '@hourly' when 2 then '@weekly'
                                           when 3 then '@monthly' else '@yearly' end
                          else concat('0 0 ', 1 + v % 28, ' * *') end as cron_expr,
                     case kind when 1 then '' when 2 then 'America/New_York' when 7 then 'Asia/Kolkata'
                          when 9 then case when v % 4 = 3 then 'Mars/Olympus' else 'UTC' end
                          else 'UTC' end as timezone
              from (select s_suppkey, s_suppkey % 10 as kind, idiv(s_suppkey, 10) as v from @supplier) k) s
    """,
    # The same declarations before keys are resolved: two of three have no explicit key.
    "schedule_defs": """
        select job_key, case when sort_index % 3 = 0 then concat(' explicit_', sort_index, ' ') else '' end as schedule_key,
               cron_expr, timezone, is_enabled, sort_index
        from @schedules
    """,
    "schedule_state": """
        select job_key, schedule_key, ts('2024-01-10 11:59:45') as last_checked_at,
               case when sort_index % 4 = 0 then ts('2024-01-10 12:00:00') else null end as last_enqueued_at
        from @schedules where sort_index % 2 = 0
        union all
        select 'retired_job' as job_key, schedule_key, ts('2024-01-10 11:59:45') as last_checked_at,
               null as last_enqueued_at
        from @schedules where sort_index % 3 = 1
    """,
    "schedule_claims": """
        select sort_index + 1 as id, job_key, schedule_key, ts('2024-01-10 12:00:00') as scheduled_for,
               concat('run_', sort_index) as run_key
        from @schedules where sort_index % 5 = 3
        union all
        select sort_index + 1000000001 as id, 'retired_job' as job_key, schedule_key,
               ts('2024-01-10 12:00:00') as scheduled_for, '' as run_key
        from @schedules where sort_index % 3 = 1
    """,
    "heartbeats": """
        select concat('scheduler_', user_id % 5) as scheduler_key, ts(ts) as last_heartbeat_at,
               case when event_id % 3 <> 0 then ts(ts) end as last_tick_started_at,
               case when event_type <> 'error' then ts(ts) end as last_tick_completed_at,
               case when event_type = 'error' then concat('tick ', event_id, ' failed') else '' end as last_error
        from @events
    """,
    # Status words in many spellings, known and unknown.
    "spellings": """
        select event_id as id, case event_id % 18 when 0 then 'success' when 1 then ' SUCCESS ' when 2 then 'Cancelled'
               when 3 then 'canceled' when 4 then 'IN_PROGRESS' when 5 then 'running' when 6 then 'idle'
               when 7 then 'queued' when 8 then 'not_started' when 9 then 'todo' when 10 then 'completed'
               when 11 then 'complete' when 12 then 'skipped' when 13 then 'failed' when 14 then 'Failed '
               when 15 then '' when 16 then 'pending' else concat('odd_', event_type) end as status
        from @events
    """,
    # Times as text in the stored formats, absent, and unreadable.
    "time_texts": """
        select o_orderkey as id, case o_orderkey % 6
               when 0 then concat(cast(1995 + o_orderkey % 30 as varchar(4)), '-03-0', 1 + o_orderkey % 9, 'T04:05:06Z')
               when 1 then concat('2001-11-1', o_custkey % 10, 'T23:59:59.', 100000000 + o_orderkey % 899999999, 'Z')
               when 2 then concat('2012-02-2', o_custkey % 9, 'T01:30:00+05:30')
               when 3 then concat('1999-07-0', 1 + o_custkey % 9, ' 10:20:30')
               when 4 then ''
               else concat('yesterday ', o_custkey) end as raw
        from @orders
    """,
    # The same graphs with step keys whose order has nothing to do with the edges.
    "mixed_nodes": """
        select job_id, concat('n', (sort_index * 5 + job_id) % 8) as step_key, sort_index from @job_nodes
    """,
    "mixed_edges": """
        select job_id, concat('n', (cast(substr(from_step_key, 2) as bigint) * 5 + job_id) % 8) as from_step_key,
               concat('n', (cast(substr(to_step_key, 2) as bigint) * 5 + job_id) % 8) as to_step_key
        from @job_edges
    """,
    # Graphs before validation: empty and repeated keys, unknown dependencies, cycles, self-loops.
    "draft_nodes": """
        select job_id, case when cast(q as bigint) % 17 = 0 then '' when cast(q as bigint) % 19 = 0 then 's1'
                            else step_key end as step_key
        from @job_nodes
    """,
    "draft_edges": """
        select job_id, case when job_id % 13 = 0 then concat('x', substr(from_step_key, 2)) else from_step_key end
                   as from_step_key, to_step_key from @job_edges
        union all
        select job_id, to_step_key as from_step_key, from_step_key as to_step_key from @job_edges where job_id % 29 = 0
        union all
        select job_id, step_key as from_step_key, step_key as to_step_key from @job_nodes where job_id % 31 = 0
    """,
    # Step contracts: the declared output type of each step and the typed input fields of each step.
    "contract_outputs": """
        select job_id, step_key, concat('main.Out', rf) as type_name from @job_nodes
    """,
    "contract_fields": """
        select job_id, step_key, cast(1 as bigint) as field_pos, 'Primary' as field_name,
               case sort_index % 4 when 0 then '[]main.OutA' when 1 then '*main.OutN' when 2 then 'main.OutR'
                    else '[]main.OutN' end as field_type
        from @job_nodes
        union all
        select job_id, step_key, cast(2 as bigint) as field_pos, 'Extra' as field_name,
               case sort_index % 5 when 0 then '*main.OutA' when 1 then '[]string' when 2 then 'int64'
                    else '*main.OutR' end as field_type
        from @job_nodes where sort_index % 3 = 0
    """,
}

_REF = re.compile(r"@(" + "|".join([*VIEWS, *RAW]) + r")\b")


def _balanced(sql: str, name: str, render) -> str:
    """Replace every ``name(a, b, ...)`` in ``sql`` by ``render(a, b, ...)``, innermost last."""
    pattern = re.compile(rf"\b{name}\(")
    while True:
        found = pattern.search(sql)
        if not found:
            return sql
        depth, start, args = 1, found.end(), []
        pos = start
        while depth:
            char = sql[pos]
            if char == "(":
                depth += 1
            elif char == ")":
                depth -= 1
            if (char == "," and depth == 1) or depth == 0:
                args.append(sql[start:pos].strip())
                start = pos + 1
            pos += 1
        sql = sql[: found.start()] + render(*args) + sql[pos:]


def spark_text(sql: str) -> str:
    sql = _balanced(sql, "add_secs", lambda ts, n: f"({ts} + make_dt_interval(0, 0, 0, {n}))")
    sql = _balanced(sql, "idiv", lambda a, b: f"(({a}) div ({b}))")
    sql = _balanced(sql, "steps", lambda *_: "explode(array(1, 2, 3))")
    return _balanced(sql, "ts", lambda x: f"cast({x} as timestamp)")


def check_text(sql: str) -> str:
    sql = _balanced(sql, "add_secs", lambda ts, n: f"({ts} + to_seconds({n}))")
    sql = _balanced(sql, "idiv", lambda a, b: f"(({a}) // ({b}))")
    sql = _balanced(sql, "steps", lambda *_: "unnest([1, 2, 3])")
    return _balanced(sql, "ts", lambda x: f"cast({x} as timestamp)")


class History:
    """Lazily built derived tables over one folder of parquet files: ``History(spark, dir).runs``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name in VIEWS:
                sql = VIEWS[name]
                inputs = {ref: getattr(self, ref) for ref in set(_REF.findall(sql))}
                text = spark_text(sql).replace("{", "{{").replace("}", "}}")
                self._built[name] = self.spark.sql(_REF.sub(r"{\1}", text), **inputs)
            elif name in RAW:
                self._built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._built[name]

    def stored(self, *names: str) -> History:
        """The same tables, with the named views written once; for queries that read them several times, by other columns each time."""
        out = History(self.spark, self.folder)
        out._built = {name: materialize(getattr(self, name), name.replace("_", "-")) for name in names}
        return out


def with_views(sql: str) -> str:
    """Prefix a checking query with the views it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for ref in _REF.findall(text):
            if ref in VIEWS and ref not in needed:
                visit(VIEWS[ref])
                needed.append(ref)

    visit(sql)
    body = check_text(_REF.sub(r"\1", sql)).strip()
    if not needed:
        return body
    parts = [f"{name} as ({check_text(_REF.sub(chr(92) + '1', VIEWS[name])).strip()})" for name in needed]
    tail = re.match(r"with\s+(recursive\s+)?", body, re.IGNORECASE)
    if tail:
        return "with recursive " + ",\n".join(parts) + ",\n" + body[tail.end() :]
    return "with recursive " + ",\n".join(parts) + "\n" + body
