"""Dependency graphs and step states (operators D16, I1, I6-I18)."""

from pyspark.sql import functions as F

from flowledger.catalog.core import query
from flowledger.functions.times import literal_time
from flowledger.operators import counts, execution, graph, layers
from flowledger.session import materialize


def _jobs(h):
    return h.runs.select(F.col("id").alias("job_id"))


def _edges(h):
    """Edges by run: in the derived tables each run has its own graph."""
    return h.job_edges.withColumnRenamed("job_id", "run_id")


query("I1_edges_of_dependencies", "select job_id, from_step_key, to_step_key from @job_edges")(
    lambda h: graph.edges_of_dependencies(
        h.job_edges.select(
            "job_id",
            F.col("to_step_key").alias("step_key"),
            F.to_json(F.struct(F.array("from_step_key").alias("depends_on"), F.array().alias("bindings"))).alias(
                "metadata_json"
            ),
        )
    )
)
query(
    "I6_graph_errors",
    """with c as (select job_id, step_key, count(*) as n from @draft_nodes group by 1, 2)
       select job_id, 'empty step key' as problem, '' as subject, cast(n as varchar) as detail from c where step_key = ''
       union all select job_id, 'duplicate step', step_key, cast(n as varchar) from c where step_key <> '' and n > 1
       union all select job_id, 'unknown dependency', to_step_key, from_step_key from @draft_edges e
                 where not exists (select 1 from c where c.job_id = e.job_id and c.step_key = e.from_step_key)
       union all select id, 'no steps', '', '' from @runs where id not in (select job_id from c)""",
)(lambda h: graph.graph_errors(_jobs(h), h.draft_nodes, h.draft_edges))
query(
    "I6_schedule_key_errors",
    """select job_key, trim(schedule_key) as schedule_key, count(*) as n,
              case when trim(schedule_key) = '' then 'empty schedule key' else 'duplicate schedule key' end as problem
       from @schedule_defs group by 1, 2 having trim(schedule_key) = '' or count(*) > 1""",
)(lambda h: graph.schedule_key_errors(h.schedule_defs))

# Cyclic jobs: repeatedly drop edges whose source has no incoming edge; bounded by the seven steps of a job.
_KNOWN_DRAFT = """(select distinct e.job_id, e.from_step_key, e.to_step_key from @draft_edges e
    where exists (select 1 from @draft_nodes n where n.job_id = e.job_id and n.step_key = e.from_step_key)
      and exists (select 1 from @draft_nodes n where n.job_id = e.job_id and n.step_key = e.to_step_key))"""
query(
    "I7_cyclic_jobs",
    f"""with recursive e as materialized {_KNOWN_DRAFT},
         r as (select job_id, from_step_key as a, to_step_key as b from e
               union select r.job_id, r.a, e.to_step_key from r join e on e.job_id = r.job_id and e.from_step_key = r.b),
         cyc as (select distinct job_id, a from r where a = b),
         stuck as (select job_id, a as step_key from cyc
                   union select r.job_id, r.b from r join cyc c on c.job_id = r.job_id and c.a = r.a)
        select job_id, count(*) as stuck_steps from stuck group by 1""",
)(lambda h: graph.cyclic_jobs(layers.graph_layers(h.draft_nodes, h.draft_edges)))
query(
    "I8_topological_order",
    """with recursive n as materialized (select job_id, step_key from @mixed_nodes),
         e as materialized (select * from @mixed_edges),
         s as (select job_id, cast(-1 as bigint) as topo_index, '' as step_key, cast([] as varchar[]) as done
               from (select distinct job_id from n) j
               union all
               select s.job_id, s.topo_index + 1, min(n.step_key), list_append(s.done, min(n.step_key))
               from s join n on n.job_id = s.job_id
               where not list_contains(s.done, n.step_key)
                 and not exists (select 1 from e where e.job_id = n.job_id and e.to_step_key = n.step_key
                                 and not list_contains(s.done, e.from_step_key))
               group by s.job_id, s.topo_index, s.done)
       select job_id, step_key, topo_index from s where topo_index >= 0""",
)(lambda h: graph.graph_order(h.mixed_nodes, h.mixed_edges).select("job_id", "step_key", "topo_index"))


def _customer_chain(h):
    """One graph over all customers: each depends on the one before, and keys run against the order."""
    keys = h.customer.select(F.lit(1).cast("long").alias("job_id"), F.format_string("c%012d", F.lit(10**12 - 1) - F.col("c_custkey")).alias("step_key"), "c_custkey")
    before = keys.select("job_id", (F.col("c_custkey") + 1).alias("c_custkey"), F.col("step_key").alias("from_step_key"))
    edges = keys.join(before, ["job_id", "c_custkey"]).select("job_id", "from_step_key", F.col("step_key").alias("to_step_key"))
    return keys.select("job_id", "step_key"), edges


query(
    "I8_order_of_a_long_chain",
    """select 1::bigint as job_id, 'c' || lpad(cast(999999999999 - c_custkey as varchar), 12, '0') as step_key,
              row_number() over (order by c_custkey) - 1 as depth, row_number() over (order by c_custkey) - 1 as topo_index, false as stuck
       from @customer""",
)(lambda h: graph.graph_order(*_customer_chain(h)))
_DEPTH_SQL = """
    d as (select n.job_id, n.step_key, 0 as depth from @job_nodes n
          where not exists (select 1 from @job_edges e where e.job_id = n.job_id and e.to_step_key = n.step_key)
          union select e.job_id, e.to_step_key, d.depth + 1 from d
          join @job_edges e on e.job_id = d.job_id and e.from_step_key = d.step_key),
    depths as (select job_id, step_key, cast(max(depth) as bigint) as depth from d group by 1, 2)"""


def _order(h):
    return graph.graph_order(h.job_nodes, h.job_edges)


query("I9_depth", f"with recursive {_DEPTH_SQL} select job_id, step_key, depth from depths")(
    lambda h: layers.graph_layers(h.job_nodes, h.job_edges).select("job_id", "step_key", "depth")
)
query(
    "I9_depth_of_a_long_chain",
    """select 1::bigint as job_id, 'c' || lpad(cast(999999999999 - c_custkey as varchar), 12, '0') as step_key,
              row_number() over (order by c_custkey) - 1 as depth, false as stuck from @customer""",
)(lambda h: layers.graph_layers(*_customer_chain(h)))


def _wide_graph(h):
    """One graph: all customers, the orders that depend on them, and one last step that depends on all orders."""
    job = F.lit(1).cast("long").alias("job_id")
    orders = h.orders.select(job, F.concat(F.lit("c"), "o_custkey").alias("from_step_key"), F.concat(F.lit("o"), "o_orderkey").alias("to_step_key"))
    last = orders.select("job_id", F.col("to_step_key").alias("from_step_key"), F.lit("end").alias("to_step_key"))
    customers = h.customer.select(job, F.concat(F.lit("c"), "c_custkey").alias("step_key"))
    nodes = customers.unionByName(orders.select("job_id", F.col("to_step_key").alias("step_key"))).unionByName(last.select("job_id", F.lit("end").alias("step_key")).distinct())
    return nodes, orders.unionByName(last)


def _with_shortcuts(nodes, edges):
    """The edges, and one from every customer straight to the last step, which its orders make redundant."""
    orders = edges.filter("to_step_key <> 'end'").select("job_id", "from_step_key", F.lit("end").alias("to_step_key"))
    return edges.unionByName(orders.distinct())


query(
    "I9_depth_of_a_wide_graph",
    """select 1::bigint as job_id, 'c' || c_custkey as step_key, 0::bigint as depth, false as stuck from @customer
       union all select 1, 'o' || o_orderkey, 1, false from @orders union all select 1, 'end', 2, false""",
)(lambda h: layers.graph_layers(*_wide_graph(h)))
query(
    "I10_adjacency",
    f"""with e as {_KNOWN_DRAFT}
        select job_id, to_step_key as step_key, 'depends_on' as side, from_step_key as other from e
        union all select job_id, from_step_key, 'needed_by', to_step_key from e""",
)(lambda h: graph.adjacency(h.draft_nodes, h.draft_edges))
query(
    "I11_degrees",
    """with i as (select job_id, to_step_key as k, count(*) as n from @job_edges group by 1, 2),
            o as (select job_id, from_step_key as k, count(*) as n from @job_edges group by 1, 2)
       select a.job_id, a.step_key, coalesce(i.n, 0) as in_degree, coalesce(o.n, 0) as out_degree,
              i.n is null as is_root, o.n is null as is_sink
       from @job_nodes a left join i on i.job_id = a.job_id and i.k = a.step_key
       left join o on o.job_id = a.job_id and o.k = a.step_key""",
)(lambda h: graph.degrees(h.job_nodes, h.job_edges))


def _edge_spans(h):
    """Edges are worked out once and stored: they give the depths and then meet them."""
    edges = materialize(h.job_edges, "job-edges")
    return graph.edge_spans(edges, layers.graph_layers(h.job_nodes, edges))


query(
    "I12_edge_spans",
    f"""with recursive {_DEPTH_SQL}
        select e.job_id, e.from_step_key, e.to_step_key, a.depth as from_depth, b.depth as to_depth,
               b.depth - a.depth >= 2 as long_span, a.depth >= b.depth as back_edge
        from @job_edges e join depths a on a.job_id = e.job_id and a.step_key = e.from_step_key
        join depths b on b.job_id = e.job_id and b.step_key = e.to_step_key""",
)(_edge_spans)
query(
    "I13_neighbourhood",
    """select job_id, step_key, step_key as related from @job_nodes
       union select job_id, to_step_key, from_step_key from @job_edges
       union select job_id, from_step_key, to_step_key from @job_edges""",
)(lambda h: graph.neighbourhood(h.job_nodes, h.job_edges))
_REACH_SQL = """
    r as (select job_id, from_step_key, to_step_key from @job_edges
          union select r.job_id, r.from_step_key, e.to_step_key from r
          join @job_edges e on e.job_id = r.job_id and e.from_step_key = r.to_step_key)"""
query("I14_reachable_pairs", f"with recursive {_REACH_SQL} select job_id, from_step_key, to_step_key from r")(
    lambda h: graph.reachable(h.job_edges).select("job_id", "from_step_key", "to_step_key")
)
query(
    "I14_reduced_edges",
    f"""with recursive {_REACH_SQL}
        select e.job_id, e.from_step_key, e.to_step_key from @job_edges e where not exists (
            select 1 from @job_edges f join r on r.job_id = f.job_id and r.from_step_key = f.to_step_key
            where f.job_id = e.job_id and f.from_step_key = e.from_step_key and r.to_step_key = e.to_step_key)""",
)(lambda h: layers.reduced_edges(h.job_edges))
query(
    "I14_reduced_edges_of_a_wide_graph",
    """select 1::bigint as job_id, 'c' || o_custkey as from_step_key, 'o' || o_orderkey as to_step_key from @orders
       union all select 1, 'o' || o_orderkey, 'end' from @orders""",
)(lambda h: layers.reduced_edges(_with_shortcuts(*_wide_graph(h))))
query(
    "I15_ready_steps",
    """select s.run_id, s.step_key from @run_steps s where s.status = 'pending' and not exists (
           select 1 from @job_edges e join @run_steps d on d.run_id = e.job_id and d.step_key = e.from_step_key
           where e.job_id = s.run_id and e.to_step_key = s.step_key and d.status <> 'success')""",
)(lambda h: execution.ready_steps(h.run_steps, _edges(h)))
query(
    "I16_skipped_steps",
    """with recursive x as (
           select run_id, step_key from @run_steps where status in ('failed', 'skipped')
           union
           select s.run_id, s.step_key from x join @job_edges e on e.job_id = x.run_id and e.from_step_key = x.step_key
           join @run_steps s on s.run_id = e.job_id and s.step_key = e.to_step_key and s.status = 'pending')
       select x.run_id, x.step_key, 'skipped' as status, 'dependency output unavailable' as error_message
       from x join @run_steps s on s.run_id = x.run_id and s.step_key = x.step_key where s.status = 'pending'""",
)(lambda h: execution.skipped_steps(h.run_steps, _edges(h)))


def _skip_chain(h):
    """A run over all customers, in which the first of each ten thousand fails and all others wait for the one before."""
    nodes, edges = _customer_chain(h)
    nth = F.lit(10**12 - 1) - F.substring("step_key", 2, 12).cast("long")
    steps = nodes.select(F.col("job_id").alias("run_id"), "step_key", F.when(nth % 10000 == 1, F.lit("failed")).otherwise(F.lit("pending")).alias("status"))
    return steps, edges.withColumnRenamed("job_id", "run_id")


query(
    "I16_skips_along_a_long_chain",
    """select 1::bigint as run_id, 'c' || lpad(cast(999999999999 - c_custkey as varchar), 12, '0') as step_key, 'skipped' as status,
              'dependency output unavailable' as error_message
       from @customer where c_custkey % 10000 <> 1 and c_custkey > (select min(c_custkey) from @customer where c_custkey % 10000 = 1)""",
)(lambda h: execution.skipped_steps(*_skip_chain(h)))
query(
    "I17_rerun_plan",
    """with r as (select id as run_id, parent_run_id, rerun_step_key from @runs where rerun_step_key <> ''),
            starved as (select distinct r.run_id from r join @job_edges e on e.job_id = r.run_id and e.to_step_key = r.rerun_step_key
                        where not exists (select 1 from @run_steps p where p.run_id = r.parent_run_id
                                          and p.step_key = e.from_step_key and p.status = 'success'))
       select s.run_id, s.step_key,
              case when s.step_key = r.rerun_step_key and x.run_id is null then 'run' else 'skipped' end as action,
              case when s.step_key <> r.rerun_step_key then 'rerun skipped'
                   when x.run_id is not null then 'dependency output unavailable' else '' end as reason
       from @run_steps s join r on r.run_id = s.run_id left join starved x on x.run_id = s.run_id""",
)(lambda h: execution.rerun_plan(h.runs, h.run_steps, _edges(h)))
query(
    "I18_canceled_steps",
    """select s.run_id, s.step_key, 'canceled' as status, timestamp '2002-01-01' as completed_at,
              case when s.duration_ms > 0 then s.duration_ms when s.started_at is null then 0
                   else greatest(0, epoch_ms(timestamp '2002-01-01') - epoch_ms(s.started_at)) end as duration_ms,
              s.output_json, 'stopped' as error_message, 'step canceled' as log_excerpt
       from @run_steps s join @runs r on r.id = s.run_id
       where r.status = 'cancelled' and s.status not in ('success', 'failed', 'skipped', 'canceled')""",
)(
    lambda h: execution.canceled_steps(
        h.runs.filter("status = 'cancelled'").select(F.col("id").alias("run_id")),
        h.run_steps,
        literal_time("2002-01-01 00:00:00"),
        "stopped",
    )
)
query(
    "D16_run_outcome",
    """with f as (select run_id, min(sort_index) as i from @run_steps where status = 'failed' group by 1)
       select s.run_id, case when max(f.i) is null then 'success' else 'failed' end as status,
              coalesce(max(case when s.sort_index = f.i then s.error_message end), '') as error_message
       from @run_steps s left join f on f.run_id = s.run_id group by 1""",
)(
    lambda h: counts.run_outcome(
        h.run_steps.join(
            _order(h).select(F.col("job_id").alias("run_id"), "step_key", "topo_index"), ["run_id", "step_key"]
        ),
        order="topo_index",
    )
)
