"""Feeds derived from the given tables: strings with the usual dirt in them.

The mappings are those of FIXTURES.md part 2. They give the cleaners and validators a
deterministic input of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_tickets(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """Tickets from `events`; `repeated` sends every 50th ticket again, as open."""
    events = table(spark, sf_dir, "events").selectExpr(
        "*", "cast(get_json_object(props, '$.k') as int) as k",
        "ts + make_dt_interval(0, 0, 0, cast(floor(value * 1800) as decimal(18, 6))) as done",
    )
    copy = "explode(if(event_id % 50 = 0, array(0, 1), array(0)))" if repeated else "0"
    return events.selectExpr("*", f"{copy} as copy").selectExpr(
        "event_id + copy * 10000000 as row_index",
        "'TKT-' || event_id as ticket_id",
        "if(event_id % 101 = 0, 'bad-date', substring(cast(ts as string), 1, 19)) as created_at",
        "case when event_id % 10 < 7 then substring(cast(done as string), 1, 19) end"
        " as resolved_at",
        "event_type as category",
        "case when event_id % 89 = 0 then 'invalid_priority' when k % 10 < 3 then 'LOW'"
        " when k % 10 < 7 then 'Medium' when k % 10 < 9 then ' HIGH ' else 'critical' end"
        " as priority",
        "case when copy = 1 then 'open' when event_id % 10 < 4 then 'resolved'"
        " when event_id % 10 < 7 then 'Closed' when event_id % 10 < 8 then 'in_progress'"
        " else 'open' end as status",
        "case user_id % 6 when 0 then 'ENG' when 1 then 'OPS' when 2 then 'SUPPORT'"
        " when 3 then 'SALES' when 4 then 'HR' else 'FINANCE' end as department_code",
        "case event_id % 4 when 0 then 'email' when 1 then 'portal' when 2 then 'phone' end"
        " as channel",
        "cast((k - 50) / 50.0D as string) as sentiment_score",
        "if(k >= 95, 'true', 'false') as escalated",
        "cast(k as string) as first_response_minutes",
    )


def raw_ticket_records(spark: SparkSession, sf_dir: str, repeated: bool = False) -> DataFrame:
    """The same tickets under the names of the record load, ticket numbers in lower case."""
    feed = raw_tickets(spark, sf_dir, repeated)
    names = [c for c in feed.columns if c != "ticket_id"]
    return feed.selectExpr("lower(' ' || ticket_id || ' ') as ticket_number", *names)


def raw_workforce(spark: SparkSession, sf_dir: str, shift_days: int = 0,
                  key: str = "employee_id") -> DataFrame:
    """Daily hours from `lineitem`; `shift_days` moves the dates onto those of the tickets."""
    line = table(spark, sf_dir, "lineitem")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    # nation is a fixed list of 25 countries at every scale; supplier grows and is left to Spark, which knows
    # the size of the table, but not that of a join: so the lines meet the suppliers first
    place = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return line.join(place, F.col("l_suppkey") == F.col("s_suppkey")).join(
        F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")
    ).selectExpr(
        "*", "if(l_linenumber % 3 = 0, 4.0D, 8.0D) as s"
    ).selectExpr(
        "struct(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as row_index",
        f"'EMP' || l_suppkey as {key}",
        "if(l_orderkey % 97 = 0, 'bad-date',"
        f" cast(date_add(cast(l_shipdate as date), {shift_days}) as string)) as date",
        "case when l_partkey % 211 = 0 then 'abc' when l_partkey % 199 = 0 then '30'"
        " else cast(s as string) end as scheduled_hours",
        "case when l_quantity <= 2 then '0' when l_quantity = 50 then '-1'"
        " else cast(round(s * (0.7D + l_quantity / 100), 2) as string) end as actual_hours",
        "cast(floor(l_quantity / 5) as string) as tasks_completed",
        "'10' as tasks_assigned",
        "cast(round(s * (0.75D + l_tax * 5), 2) as string) as demand_units",
        "cast(s * 0.95D as string) as capacity_units",
        "if(l_partkey % 23 = 0, null, 'D' || n_regionkey) as department_code",
        "n_name as location_code",
    )


def raw_operations_records(spark: SparkSession, sf_dir: str, shift_days: int = 0) -> DataFrame:
    """The same hours under the names of the record load."""
    return raw_workforce(spark, sf_dir, shift_days, key="employee_code")


def raw_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market signals from `orders`."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # both are fixed lists (25 and 5 rows); customer grows and is left to Spark
    place = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    buyer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    orders = table(spark, sf_dir, "orders")
    return orders.join(buyer, F.col("o_custkey") == F.col("c_custkey")).join(
        F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")
    ).selectExpr(
        "o_orderkey as row_index",
        "if(o_orderkey % 103 = 0, 'n/a', cast(cast(o_orderdate as date) as string))"
        " as signal_date",
        "'src_' || (o_custkey % 5) as source",
        "'Signal ' || o_orderkey as title",
        "case o_orderpriority when '1-URGENT' then 'competitor' when '2-HIGH' then 'Market'"
        " when '3-MEDIUM' then ' hiring ' when '4-NOT SPECIFIED' then 'technology'"
        " else 'gossip' end as category",
        "if(o_custkey % 7 = 0, null, c_mktsegment) as industry",
        "r_name as region",
        "cast(o_totalprice as string) as value",
        "cast(floor(c_acctbal / 100) as string) as change_pct",
        "cast((o_custkey % 31 - 15) / 10.0D as string) as sentiment_score",
        "case o_orderkey % 3 when 0 then 'a, b,,c ' when 1 then '' end as tags",
    )


def raw_employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employee records from `supplier`; codes repeat above 80 suppliers."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return table(spark, sf_dir, "supplier").join(
        F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")
    ).selectExpr(
        "s_suppkey as row_index",
        "' emp' || (s_suppkey % 80) as employee_code",
        "if(s_suppkey % 17 = 0, '', s_name) as full_name",
        "if(s_suppkey % 13 = 0, 'not-an-email', 'EMP' || s_suppkey || '@Company.com') as email",
        "'Analyst' as role",
        "'D' || n_regionkey as department_code",
        "if(s_suppkey % 19 = 0, '31/31/2020', '20' || lpad(10 + s_suppkey % 14, 2, '0')"
        " || '-0' || (1 + s_suppkey % 9) || '-15') as hire_date",
        "if(s_suppkey % 11 = 0, 'abc', cast(s_acctbal as string)) as hourly_rate",
    )
