"""Artifacts, contracts, user functions and example pipelines (operators A4, A5, A12, H29, I2-I5, I19, L1-L4, M1-M8)."""

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from flowledger.catalog.core import query
from flowledger.operators import content, contracts, dictionary, graph, steps
from flowledger.operators.calendars import tasks
from flowledger.session import materialize, scratch_path
from flowledger.sources import artifacts

BASE = ["Page", "Workflow"]
TERMS = ["The", "and", "SQLite", "De", "html", "Et"]


def _pages(h):
    return artifacts.page_scan(h.pages)


query("A4_page_scan", "select url, html as body, cast(200 as bigint) as status from @pages")(_pages)
query("A5_object_scan")(
    lambda h: artifacts.object_digests(artifacts.object_scan(h.spark, h.folder), artifacts.whole_bytes(h.spark, h.folder)).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "length", "digest"
    )
)


def _page_artifacts(h):
    return artifacts.artifacts(h.pages, F.concat(F.lit("pages/"), "page_id", F.lit(".html")), F.col("html"), "entities")


def _page_files(h):
    """Each page's body as an object of its own; the writer ends it with a line feed.

    Where Spark writes them, tasks move their own files into place: with an object per page, the driver alone would rename them one by one.
    """
    path = scratch_path(h.spark, "page-files")
    bodies = h.pages.select("page_id", F.col("html").alias("value")).repartition(tasks(h.spark), "page_id")
    if artifacts.shared_folder(h.spark, path):
        folder = F.concat(F.lit("page_id="), F.coalesce(F.col("page_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
        artifacts.write_objects(bodies.withColumn("folder", folder), path)
    else:
        bodies.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("page_id").text(path)
    return path


query(
    "A5_listed_objects",
    "select cast(page_id as varchar) as page_id, cast(strlen(html) + 1 as bigint) as length from @pages",
)(
    lambda h: artifacts.object_scan(h.spark, _page_files(h), "*.txt").select(
        F.regexp_extract("path", "page_id=([0-9]+)/", 1).alias("page_id"), "length"
    )
)
query(
    "A5_existing_objects",
    """select 'pages/' || e.event_id || '.html' as blob_path from @events e
       where e.event_id in (select page_id from @pages)""",
)(
    lambda h: artifacts.existing(
        h.events.select(F.concat(F.lit("pages/"), "event_id", F.lit(".html")).alias("blob_path")),
        artifacts.write_artifacts(_page_artifacts(h), scratch_path(h.spark, "artifacts")),
    )
)
query(
    "A12_artifact_manifest",
    """select 'pages/' || page_id || '.html' as blob_path, 'text/plain' as content_type, cast(strlen(html) as bigint) as n_bytes,
              's3://entities/pages/' || page_id || '.html' as uri from @pages""",
)(lambda h: artifacts.write_artifacts(_page_artifacts(h), scratch_path(h.spark, "artifacts")))


def _documents(h):
    value = F.struct(F.col("id"), F.col("job_key").alias("key"), F.struct("display_name").alias("names"))
    rows = h.queue_items.join(h.jobs.select(F.col("id").alias("queue_id"), "job_key", "display_name"), "queue_id")
    out = artifacts.artifacts(rows, F.col("queue_item_key"), value, "b")
    return out.select(
        "blob_path", F.decode("body", "UTF-8").alias("body"), "content_type",
        artifacts.public_url(" https://files.example/ ", "b", F.col("blob_path")).alias("url"),
    )


query(
    "H29_document_bodies",
    """select i.queue_item_key as blob_path,
              '{' || chr(10) || '  "id": ' || i.id || ',' || chr(10) || '  "key": "' || j.job_key || '",' || chr(10)
              || '  "names": {' || chr(10) || '    "display_name": "' || j.display_name || '"' || chr(10) || '  }' || chr(10)
              || '}' as body, 'application/json' as content_type, 'https://files.example/b/' || i.queue_item_key as url
       from @queue_items i join @jobs j on j.id = i.queue_id""",
)(_documents)

_MODES = """
    select *, case when field_type like '[]%' then 'slice' when field_type like '*%' then 'pointer' else 'singular' end as mode,
           replace(replace(field_type, '[]', ''), '*', '') as target_type,
           replace(replace(field_type, '[]', ''), '*', '') not in ('string', 'int64') as usable
    from @contract_fields"""
_CANDIDATES = f"""
    m as ({_MODES}),
    c as (select m.job_id, m.step_key, m.field_pos, m.field_name, m.mode, m.target_type, o.step_key as provider
          from m join @contract_outputs o on o.job_id = m.job_id and o.type_name = m.target_type and o.step_key <> m.step_key
          where m.usable),
    n as (select m.job_id, m.step_key, m.field_pos, m.field_name, m.field_type, m.mode, m.target_type, m.usable,
                 count(c.provider) as candidates, string_agg(c.provider, ', ' order by c.provider) as names
          from m left join c using (job_id, step_key, field_pos) group by all)"""
query(
    "I4_field_modes",
    f"""select job_id, step_key, field_pos, mode, target_type, case when usable then '' else 'unsupported ' || mode
               || ' input type ' || field_type || ': expected ' || case mode when 'slice' then '[]T' when 'pointer' then '*T'
               else 'T' end || ' where T is a struct' end as error from ({_MODES}) x""",
)(
    lambda h: contracts.field_modes(h.contract_fields).select(
        "job_id", "step_key", "field_pos", "mode", "target_type", "error"
    )
)
_BOUND = f"""
    {_CANDIDATES},
    b as (select c.* from c join n using (job_id, step_key, field_pos) where c.mode = 'slice' or n.candidates = 1)"""
query("I2_providers", f"with {_BOUND} select job_id, step_key, field_pos, field_name, mode, target_type, provider from b")(
    lambda h: contracts.providers(h.contract_fields, h.contract_outputs)
)
query(
    "I3_contract_errors",
    f"""with {_CANDIDATES}
        select job_id, step_key, field_pos, field_name, case
            when not usable then 'input field ' || field_name || ': unsupported ' || mode || ' input type ' || field_type
                 || ': expected ' || case mode when 'slice' then '[]T' when 'pointer' then '*T' else 'T' end
                 || ' where T is a struct'
            when candidates = 0 then 'input field ' || field_name || ' (' || target_type || ') requires exactly 1 provider, found 0'
            else 'input field ' || field_name || ' (' || target_type || ') is ambiguous: ' || case mode when 'pointer'
                 then 'pointer input allows 0 or 1 provider' else 'expected exactly 1 provider' end || ', found '
                 || candidates end as message
        from n where not usable or (mode = 'singular' and candidates = 0) or (mode <> 'slice' and candidates > 1)""",
)(lambda h: contracts.contract_errors(h.contract_fields, h.contract_outputs))
query(
    "I3_ambiguous_candidates",
    f"""with {_CANDIDATES}
        select n.job_id, n.step_key, n.field_pos, n.field_name, o.step_key as candidate
        from n join @contract_outputs o on o.job_id = n.job_id and o.type_name = n.target_type and o.step_key <> n.step_key
        where n.usable and n.mode <> 'slice' and n.candidates > 1""",
)(lambda h: contracts.ambiguous_candidates(h.contract_fields, h.contract_outputs))


def _ordered(h):
    order = graph.graph_order(h.job_nodes, h.job_edges)
    return contracts.ordered_providers(contracts.providers(h.contract_fields, h.contract_outputs), order)


_INDEX = "(select *, row_number() over (partition by job_id order by sort_index) - 1 as provider_index from @job_nodes)"
query(
    "I5_ordered_providers",
    f"""with {_BOUND}
        select b.job_id, b.step_key, b.field_pos, b.provider, x.provider_index from b
        join {_INDEX} x on x.job_id = b.job_id and x.step_key = b.provider""",
)(lambda h: _ordered(h).select("job_id", "step_key", "field_pos", "provider", "provider_index"))

_UNDECODABLE = ('{"v":', '{"v":"text"}', '{"v":1.5}', "[1]")
_VALUE = StructType([StructField("v", LongType())])


def _inputs(h):
    h = h.stored("job_nodes")
    runs = h.job_nodes.select(F.col("job_id").alias("run_id"), "job_id").distinct()
    produced = h.run_steps.filter("status in ('success', 'failed')").withColumn(
        # Failed steps leave what can't be decoded: cut-off text, a wrong type, a fraction, an array. Some others leave null.
        "output_json",
        F.when(F.col("status") == "failed", F.get(F.array(*map(F.lit, _UNDECODABLE)), (F.col("sort_index") % 4).cast("int")))
        .when(F.col("run_id") % 7 == 0, F.lit("null"))
        .otherwise(F.col("output_json")),
    )
    return contracts.step_inputs(runs, _ordered(h), produced, _VALUE)


_INPUT_ERROR = """case when s.status is null then 'missing output from dependency ' || b.provider || ' for '
        || case b.mode when 'slice' then 'slice ' else '' end || 'field ' || b.field_name
    when s.status = 'failed' then 'decode dependency ' || b.provider || ' into '
        || case b.mode when 'singular' then '' else b.mode || ' ' end || 'field ' || b.field_name else '' end"""
_PRODUCED = "(select * from @run_steps where status in ('success', 'failed'))"
query(
    "I19_step_inputs",
    f"""with {_BOUND}
        select b.job_id as run_id, b.step_key, b.field_pos, b.provider, b.mode,
               case when s.status = 'success' and s.run_id % 7 <> 0 then s.sort_index end as v, {_INPUT_ERROR} as error
        from b left join {_PRODUCED} s on s.run_id = b.job_id and s.step_key = b.provider""",
)(
    lambda h: _inputs(h).select(
        "run_id", "step_key", "field_pos", "provider", "mode", F.col("value.v").alias("v"), "error"
    )
)
query(
    "I19_input_errors",
    f"""with {_BOUND},
        e as (select b.job_id as run_id, b.step_key, b.field_pos, x.provider_index, {_INPUT_ERROR} as error
              from b join {_INDEX} x on x.job_id = b.job_id and x.step_key = b.provider
              left join {_PRODUCED} s on s.run_id = b.job_id and s.step_key = b.provider)
        select run_id, step_key, first(error order by field_pos, provider_index) as error
        from e where error <> '' group by 1, 2""",
)(lambda h: contracts.input_errors(_inputs(h)))

_ORDER_IN = StructType([StructField("o_orderkey", LongType()), StructField("o_totalprice", DoubleType())])
_ORDER_OUT = StructType([StructField("o_orderkey", LongType()), StructField("band", StringType())])
query("L1_typed_step", "select o_orderkey, case when o_totalprice >= 100000 then 'high' else 'low' end as band from @orders")(
    lambda h: h.orders.transform(
        steps.typed_step(
            "band_orders",
            _ORDER_IN,
            _ORDER_OUT,
            lambda df: df.withColumn("band", F.when(F.col("o_totalprice") >= 100000, F.lit("high")).otherwise(F.lit("low"))),
        )
    )
)
query("L2_partition_key_split", "select event_id, 'u' || user_id as partition_key from @events where event_type <> 'error'")(
    lambda h: steps.split_by_partition_key(
        h.events,
        F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(F.concat(F.lit(" u"), "user_id")),
    )[0].select("event_id", "partition_key")
)
query(
    "L2_rejected_rows", "select event_id, 'partition key is required' as error from @events where event_type = 'error'"
)(
    lambda h: steps.split_by_partition_key(
        h.events, F.when(F.col("event_type") != "error", F.concat(F.lit("u"), "user_id"))
    )[1].select("event_id", "error")
)
query(
    "L3_published_metadata",
    """select event_id, '{"kind":"' || event_type || '"}' as metadata_json from @events where event_type <> 'view'""",
)(
    lambda h: steps.publish_metadata(
        h.events,
        F.when(F.col("event_type") != "view", F.create_map(F.lit("kind"), F.col("event_type"))).otherwise(
            F.create_map().cast("map<string,string>")
        ),
    ).select("event_id", "metadata_json")
)


def _halve(record: dict) -> dict:
    if record["k"] % 2:
        raise ValueError(f"{record['k']} is odd")
    return {"half": record["k"] // 2}


query(
    "L4_captured_failures",
    """with k as (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from @events)
       select event_id, k, case when k % 2 = 1 then 'failed' else 'success' end as status,
              case when k % 2 = 1 then 'panic in step halve: ' || k || ' is odd' else '' end as error_message,
              case when k % 2 = 1 then '{}' else '{"half":' || (k // 2) || '}' end as output_json from k""",
)(
    lambda h: steps.capture_failures(
        h.events.select("event_id", F.from_json("props", "k long")["k"].alias("k")), "halve", _halve
    )
)

_TITLE = "coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), 'Untitled')"
_N_ENTITIES = f"({len(BASE)} + " + " + ".join(f"cast(contains(html, '{t}') as bigint)" for t in TERMS) + ")"
query("M1_page_titles", f"select url, {_TITLE} as title from @pages")(
    lambda h: _pages(h).select("url", content.page_title(F.col("body")).alias("title"))
)
query(
    "M2_page_entities",
    " union all ".join(
        [f"select url, '{b}' as entity from @pages" for b in BASE]
        + [f"select url, '{t}' as entity from @pages where contains(html, '{t}')" for t in TERMS]
    ),
)(lambda h: _pages(h).select("url", F.explode(content.page_entities(F.col("body"), BASE, TERMS)).alias("entity")))
# A dictionary of its own table: all words of the benchmark, all part names' words and all nations.
_DICTIONARY_SQL = """select distinct unnest(string_split(text, ' ')) as term from benchmark
    union select distinct unnest(string_split(p_name, ' ')) from part union select n_name from nation"""


def _dictionary(h):
    words = lambda rows, column: rows.select(F.explode(F.split(column, " ")).alias("term"))
    benchmark = h.spark.read.parquet(f"{h.folder}/benchmark.parquet")
    part = h.spark.read.parquet(f"{h.folder}/part.parquet")
    nation = h.spark.read.parquet(f"{h.folder}/nation.parquet")
    every = words(benchmark, "text").unionByName(words(part, "p_name")).unionByName(nation.select(F.col("n_name").alias("term")))
    return materialize(every.distinct(), "dictionary")


query(
    "M2_dictionary_entities",
    f"""with t as ({_DICTIONARY_SQL}) select url, term from (select distinct url, html from @pages) p join t on contains(html, term)
        where term <> '' group by url, term""",
)(lambda h: dictionary.terms_in(_pages(h), _dictionary(h), "url"))
query(
    "M3_page_links",
    """select url, url as link from @pages
       union all select url, unnest(regexp_extract_all(html, '(?i)href="([^"]*)"', 1)) from @pages
       union all select url, 'https://example.com/docs' from @pages""",
)(
    lambda h: _pages(h).select(
        "url", F.explode(content.page_links(F.col("url"), F.col("body"), ["https://example.com/docs"])).alias("link")
    )
)
query(
    "M4_index_records",
    f"""select url, {_TITLE} as title,
               {_N_ENTITIES} + 2 + len(regexp_extract_all(html, '(?i)href="([^"]*)"', 1)) + 1 as records from @pages""",
)(
    lambda h: content.index_records(_pages(h), BASE, TERMS, ["https://example.com/docs"]).select("url", "title", "records")
)
query(
    "M5_letter_counts",
    """with t as (select url, lower(regexp_replace(html, '<[^>]*>', '', 'g')) as x from @pages)
       select url, cast(length(regexp_replace(x, '[^aeiou]', '', 'g')) as bigint) as vowels,
              cast(length(regexp_replace(x, '[^b-df-hj-np-tv-z]', '', 'g')) as bigint) as consonants from t""",
)(
    lambda h: _pages(h).select(
        "url", *[c.alias(n) for c, n in zip(content.letter_counts(F.col("body")), ("vowels", "consonants"))]
    )
)
query(
    "M6_order_counts",
    """select count(*) as records_ingested, count(*) filter (where o_totalprice > 0 and o_orderstatus in ('F', 'O')) as records_cleaned,
              count(*) filter (where not (o_totalprice > 0 and o_orderstatus in ('F', 'O'))) as dropped_records from @orders""",
)(lambda h: content.order_counts(h.orders))
query(
    "M6_daily_revenue",
    """select cast(o_orderdate as date) as day, count(*) as orders,
              cast(sum(cast(o_totalprice as decimal(18, 2))) as double) as revenue
       from @orders where o_totalprice > 0 and o_orderstatus in ('F', 'O') group by 1""",
)(lambda h: content.daily_revenue(content.clean_orders(h.orders)[0]))


def _customer_items(h):
    return h.customer.select(
        "c_custkey",
        F.to_json(
            F.struct(
                F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise(F.lit(" ")).alias("customer_id"),
                F.concat(F.lit("batch-"), "c_nationkey").alias("batch_id"),
            )
        ).alias("payload_json"),
    )


query(
    "M7_imported_customers",
    """select c_custkey, c_name as partition_key, 'crm:' || c_name as external_id,
              '{"batch_id":"batch-' || c_nationkey || '","customer_id":"' || c_name || '","external_id":"crm:' || c_name || '"}'
                  as metadata_json
       from @customer where c_acctbal >= 0""",
)(
    lambda h: content.import_customers(_customer_items(h), F.col("payload_json"))[0].select(
        "c_custkey", "partition_key", "external_id", F.to_json("metadata").alias("metadata_json")
    )
)
query("M7_rejected_customers", "select c_custkey, 'customer_id is required' as error from @customer where c_acctbal < 0")(
    lambda h: content.import_customers(_customer_items(h), F.col("payload_json"))[1].select("c_custkey", "error")
)
query(
    "M8_trailing_day_features",
    """with e as (select event_id, user_id, epoch_ms(ts) // 1000 as sec, cast(round(value * 100) as bigint) as cents from @events)
       select event_id, user_id,
              count(*) over w as events_24h, cast(sum(cents) over w as bigint) as cents_24h from e
       window w as (partition by user_id order by sec range between 86399 preceding and current row)""",
)(lambda h: content.trailing_day_features(h.events))
