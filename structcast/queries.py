"""Registered queries of the extraction engine and the SQL that checks them.

The tables hold almost no dirty text, so most queries write noisy text from typed columns, as a model's answer would look,
extract from it, and expect the columns back together with the score that the noise must cost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.readings import Options
from .operators.extract import Extractor, best_candidate, feedback, quality_rollup, ruled, score_of
from .operators.sql import register
from .plans.prompt import Style
from .plans.shapes import INT, NULL, STRING, Choice, Field, ListOf, MapOf, Member, OneOf, Record, Target
from .streaming.streams import replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _object(required: bool = True, **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties) if required else []}


TEXT, WHOLE, REAL, YES_NO = {"type": "string"}, {"type": "integer"}, {"type": "number"}, {"type": "boolean"}


def _run(df: DataFrame, schema: object, text: Column, **options) -> DataFrame:
    """df with the result for a text built from its columns in r."""
    return df.withColumn("r", Extractor(schema, **options).column(text))


def _outcome(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(*columns, F.col("r.ok").alias("ok"), F.col("r.score").alias("score"))


@_query("select event_id, json_extract(props, '$.k')::bigint as k, true as ok, 0::bigint as score from events")
def strict_props(spark, sf_dir):
    """Strict JSON by the Catalyst path alone."""
    df = _run(_table(spark, sf_dir, "events"), _object(k=WHOLE), F.col("props"))
    return _outcome(df, "event_id", "r.data.k")


@_query("select event_id, json_extract(props, '$.k')::bigint as k, true as ok, 0::bigint as score from events")
def kernel_props(spark, sf_dir):
    """The same by the Arrow kernel alone."""
    events = _table(spark, sf_dir, "events")
    df = events.withColumn("r", Extractor(_object(k=WHOLE)).column("props", fast=False))
    return _outcome(df, "event_id", "r.data.k")


@_query("select event_type, count(*) as n, sum(json_extract(props, '$.k')::bigint)::bigint as total_k, 1.0::double as ok_rate from events group by 1")
def props_by_type(spark, sf_dir):
    df = _run(_table(spark, sf_dir, "events"), _object(k=WHOLE), F.col("props"))
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("r.data.k").alias("total_k"), F.avg(F.col("r.ok").cast("double")).alias("ok_rate"))


@_query("select l_orderkey, l_linenumber, l_suppkey, l_partkey as part, l_returnflag as flag, true as ok, 0::bigint as score, 1::bigint as n_flags from lineitem")
def fenced_lineitem(spark, sf_dir):
    """JSON in a code fence after a sentence."""
    text = F.format_string('Here is the line you asked for:\n```json\n{"part": %d, "flag": "%s"}\n```\nAnything else?', "l_partkey", "l_returnflag")
    df = _run(_table(spark, sf_dir, "lineitem"), _object(part=WHOLE, flag=TEXT), text)
    return _outcome(df, "l_orderkey", "l_linenumber", "l_suppkey", "r.data.part", "r.data.flag", F.size("r.flags").cast("long").alias("n_flags"))


@_query("select o_orderkey, o_custkey as customer, o_orderstatus as status, true as ok, 0::bigint as score, 'object-from-fixed-json' as kind from orders")
def prose_orders(spark, sf_dir):
    """JSON in the middle of prose."""
    text = F.format_string('Based on my analysis the order is {"customer": %d, "status": "%s"}. I hope this helps!', "o_custkey", "o_orderstatus")
    df = _run(_table(spark, sf_dir, "orders"), _object(customer=WHOLE, status=TEXT), text)
    return _outcome(df, "o_orderkey", "r.data.customer", "r.data.status", F.col("r.flags")[0]["kind"].alias("kind"))


@_query("select p_partkey, p_name as name, p_size::bigint as size, p_brand as brand, true as ok, 0::bigint as score from part")
def repair_part(spark, sf_dir):
    """Keys without quotes, single quotes, comments, and a comma too many."""
    text = F.format_string("{ // the part\n name: '%s', size: %d, /* maker */ brand: \"%s\",}", "p_name", "p_size", "p_brand")
    return _outcome(_run(_table(spark, sf_dir, "part"), _object(name=TEXT, size=WHOLE, brand=TEXT), text), "p_partkey", "r.data.name", "r.data.size", "r.data.brand")


@_query("select c_custkey, c_mktsegment as segment, null::bigint as nation, true as ok, 100::bigint as score from customer")
def truncated_customer(spark, sf_dir):
    """Text cut before the last value."""
    text = F.format_string('{"segment": "%s", "nation":', "c_mktsegment")
    return _outcome(_run(_table(spark, sf_dir, "customer"), _object(segment=TEXT, nation=WHOLE), text), "c_custkey", "r.data.segment", "r.data.nation")


@_query("select s_suppkey, s_acctbal as balance, true as ok, 1::bigint as score from supplier")
def currency_supplier(spark, sf_dir):
    amount = F.concat(F.when(F.col("s_acctbal") < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs("s_acctbal"), 2))
    text = F.concat(F.lit('{"balance": "'), amount, F.lit('"}'))
    return _outcome(_run(_table(spark, sf_dir, "supplier"), _object(balance=REAL), text), "s_suppkey", "r.data.balance")


@_query(
    "select l_orderkey, l_linenumber, l_suppkey, l_partkey, floor(l_quantity / 4 + 0.5)::bigint as q, true as ok, (case when l_quantity / 4 = floor(l_quantity / 4) then 0 else 1 end)::bigint as score from lineitem"
)
def int_rounding(spark, sf_dir):
    text = F.concat(F.lit('{"q": '), (F.col("l_quantity") / 4).cast("string"), F.lit("}"))
    return _outcome(_run(_table(spark, sf_dir, "lineitem"), _object(q=WHOLE), text), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "r.data.q")


@_query("select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity / 8 as share, true as ok, 1::bigint as score from lineitem")
def fractions(spark, sf_dir):
    text = F.format_string('{"share": "%d / 8"}', F.col("l_quantity").cast("int"))
    return _outcome(_run(_table(spark, sf_dir, "lineitem"), _object(share=REAL), text), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "r.data.share")


@_query(
    "select event_id, case event_id % 8 when 6 then null else event_id % 2 = 0 end as b, true as ok, (case event_id % 8 when 6 then 100 when 7 then 0 else 1 end)::bigint as score from events"
)
def bool_words(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, ('" TRUE "', '"no"', '"Yes"', '"0"', "1", '"False"', '"maybe"', "false"))), (F.col("event_id") % 8 + 1).cast("int"))
    return _outcome(_run(_table(spark, sf_dir, "events"), _object(b=YES_NO), F.concat(F.lit('{"b": '), word, F.lit("}"))), "event_id", "r.data.b")


@_query("select event_id, true as ok, (case event_id % 4 when 3 then 0 else 1 end)::bigint as score from events")
def null_words(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, ('"None"', '" "', '"NULL"', "null"))), (F.col("event_id") % 4 + 1).cast("int"))
    return _outcome(_run(_table(spark, sf_dir, "events"), _object(x={"type": "null"}), F.concat(F.lit('{"x": '), word, F.lit("}"))), "event_id")


SEGMENTS = {"type": "string", "enum": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}
_SEGMENT_LIST = ", ".join(f"'{s}'" for s in SEGMENTS["enum"])


@_query(f"select c_custkey, c_mktsegment as segment, c_mktsegment in ({_SEGMENT_LIST}) as ok, 0::bigint as score from customer where c_mktsegment in ({_SEGMENT_LIST})")
def enum_exact(spark, sf_dir):
    df = _run(_table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin(SEGMENTS["enum"])), SEGMENTS, F.col("c_mktsegment"))
    return _outcome(df, "c_custkey", F.col("r.data").alias("segment"))


@_query("select o_orderkey, o_orderpriority as priority, true as ok, 3::bigint as score from orders")
def enum_case(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    schema = {"type": "string", "enum": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}
    return _outcome(_run(orders, schema, F.concat(F.lit("**"), F.lower("o_orderpriority"), F.lit("**"))), "o_orderkey", F.col("r.data").alias("priority"))


@_query(f"select c_custkey, c_mktsegment as segment, true as ok, 2::bigint as score from customer where c_mktsegment in ({_SEGMENT_LIST})")
def enum_prose(spark, sf_dir):
    df = _table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin(SEGMENTS["enum"]))
    return _outcome(_run(df, SEGMENTS, F.concat(F.lit("I would say that it is "), F.lower("c_mktsegment"), F.lit(", for sure."))), "c_custkey", F.col("r.data").alias("segment"))


@_query("select n_nationkey, null::varchar as segment, false as ok, null::bigint as score, 'Failed to coerce value to target type' as error from nation")
def enum_ambiguous(spark, sf_dir):
    df = _run(_table(spark, sf_dir, "nation"), SEGMENTS, F.concat(F.lit("building or machinery for "), F.col("n_name")))
    return _outcome(df, "n_nationkey", F.col("r.data").alias("segment"), F.col("r.errors")[0].alias("error"))


PRIORITY = Target(Choice("Priority", tuple(Member(n, alias=f"k{i}", description=d) for i, (n, d) in enumerate([("P", "still pending"), ("O", "open order"), ("F", "finished fully")]))))


@_query("select o_orderkey, o_orderstatus as status, true as ok, (case o_orderkey % 3 when 0 then 0 when 1 then 0 else 2 end)::bigint as score from orders where o_orderstatus in ('P', 'O', 'F')")
def enum_alias(spark, sf_dir):
    """Members by alias, by description, and mentioned in prose."""
    df = _table(spark, sf_dir, "orders").where("o_orderstatus in ('P', 'O', 'F')")
    code = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    alias, told = (F.element_at(F.array(*map(F.lit, xs)), code + 1) for xs in (("k0", "k1", "k2"), ("still pending", "open order", "finished fully")))
    text = F.when(F.col("o_orderkey") % 3 == 0, alias).when(F.col("o_orderkey") % 3 == 1, told).otherwise(F.concat(F.lit("It is "), alias, F.lit(" now")))
    return _outcome(_run(df, PRIORITY, text), "o_orderkey", F.col("r.data").alias("status"))


@_query("select p_partkey, p_name as part_name, p_size::bigint as part_size, true as ok, 0::bigint as score from part")
def fuzzy_keys(spark, sf_dir):
    text = F.format_string('{"PartName": "%s", "PART-SIZE": %d}', "p_name", "p_size")
    return _outcome(_run(_table(spark, sf_dir, "part"), _object(part_name=TEXT, part_size=WHOLE), text), "p_partkey", "r.data.part_name", "r.data.part_size")


@_query(
    "select p_partkey, p_brand as brand, null::bigint as size, true as ok, (case when p_partkey % 2 = 0 then 2 else 1 end)::bigint as score, (case when p_partkey % 2 = 0 then 1 else 0 end)::bigint as n_extra from part"
)
def extra_missing_keys(spark, sf_dir):
    schema = {"type": "object", "properties": {"brand": TEXT, "size": WHOLE}, "required": ["brand"]}
    text = F.concat(F.format_string('{"brand": "%s"', "p_brand"), F.when(F.col("p_partkey") % 2 == 0, ', "colour": "red"').otherwise(""), F.lit("}"))
    extra = F.size(F.filter(F.col("r.flags"), lambda f: f["kind"] == "extra-key")).cast("long")
    return _outcome(_run(_table(spark, sf_dir, "part"), schema, text), "p_partkey", "r.data.brand", "r.data.size", extra.alias("n_extra"))


@_query("select n_nationkey, n_name as only, true as ok, 1::bigint as score from nation")
def single_to_list(spark, sf_dir):
    df = _run(_table(spark, sf_dir, "nation"), _object(names={"type": "array", "items": TEXT}), F.format_string('{"names": "%s"}', "n_name"))
    return _outcome(df, "n_nationkey", F.col("r.data.names")[0].alias("only"))


@_query("select s_suppkey, 2::bigint as n, s_nationkey::bigint as last, true as ok, 2::bigint as score from supplier")
def list_with_bad_items(spark, sf_dir):
    text = F.format_string('{"xs": [%d, "not a number", %d]}', F.col("s_suppkey") % 7, F.col("s_nationkey"))
    df = _run(_table(spark, sf_dir, "supplier"), _object(xs={"type": "array", "items": WHOLE}), text)
    return _outcome(df, "s_suppkey", F.size("r.data.xs").cast("long").alias("n"), F.col("r.data.xs")[1].alias("last"))


@_query("select p_partkey, p_size::bigint as size, 1::bigint as n, true as ok, 2::bigint as score from part")
def map_from_object(spark, sf_dir):
    """A map's bad value is dropped."""
    schema = {"type": "object", "additionalProperties": WHOLE}
    df = _run(_table(spark, sf_dir, "part"), schema, F.format_string('{"size": %d, "name": "%s"}', "p_size", "p_name"))
    return _outcome(df, "p_partkey", F.col("r.data")["size"].alias("size"), F.size("r.data").cast("long").alias("n"))


@_query("select event_id, case when event_id % 2 = 0 then event_id::varchar else '\"' || event_type || '\"' end as x, (case when event_id % 2 = 0 then 0 else 1 end)::int as option, true as ok, 0::bigint as score from events")
def union_int_or_string(spark, sf_dir):
    schema = _object(x={"anyOf": [WHOLE, TEXT]})
    text = F.when(F.col("event_id") % 2 == 0, F.format_string('{"x": %d}', "event_id")).otherwise(F.format_string('{"x": "%s"}', "event_type"))
    option = F.regexp_extract(F.element_at(F.filter(F.col("r.flags"), lambda f: f["kind"] == "union-match"), -1)["message"], r"(\d+)", 1).cast("int")
    return _outcome(_run(_table(spark, sf_dir, "events"), schema, text), "event_id", "r.data.x", option.alias("option"))


@_query("select event_id, case when event_id % 3 = 0 then null else user_id end as u, true as ok, (case event_id % 3 when 2 then 1 else 0 end)::bigint as score from events")
def optional_null(spark, sf_dir):
    schema = _object(u={"anyOf": [WHOLE, {"type": "null"}]})
    value = F.when(F.col("event_id") % 3 == 0, F.lit("null")).when(F.col("event_id") % 3 == 1, F.col("user_id").cast("string")).otherwise(F.format_string('"%d"', "user_id"))
    return _outcome(_run(_table(spark, sf_dir, "events"), schema, F.concat(F.lit('{"u": '), value, F.lit("}"))), "event_id", "r.data.u")


@_query(
    "select p_partkey, (p_size >= 5)::int + (p_size <= 40)::int + (p_size % 2 = 0)::int = 3 as ok, (case when p_size < 5 then 1 else 0 end + case when p_size > 40 then 1 else 0 end + case when p_size % 2 <> 0 then 1 else 0 end)::bigint as n_errors, 0::bigint as score from part"
)
def constraints_numeric(spark, sf_dir):
    schema = _object(size={"type": "integer", "minimum": 5, "maximum": 40, "multipleOf": 2})
    return _outcome(_run(_table(spark, sf_dir, "part"), schema, F.format_string('{"size": %d}', "p_size")), "p_partkey", F.size("r.errors").cast("long").alias("n_errors"))


@_query(
    "select p_partkey, length(p_name) between 8 and 12 and regexp_matches(p_name, '^[a-m]') as ok, 0::bigint as score, "
    "concat_ws('; ', case when length(p_name) < 8 then 'name: String length ' || length(p_name) || ' is less than minimum 8' end, "
    "case when length(p_name) > 12 then 'name: String length ' || length(p_name) || ' is greater than maximum 12' end, "
    "case when not regexp_matches(p_name, '^[a-m]') then 'name: String \"' || p_name || '\" does not match pattern \"^[a-m]\"' end) as errors from part"
)
def constraints_string(spark, sf_dir):
    schema = _object(name={"type": "string", "minLength": 8, "maxLength": 12, "pattern": "^[a-m]"})
    return _outcome(_run(_table(spark, sf_dir, "part"), schema, F.format_string('{"name": "%s"}', "p_name")), "p_partkey", F.array_join("r.errors", "; ").alias("errors"))


@_query("select s_suppkey, s_nationkey % 4 >= 1 and s_nationkey % 4 <= 2 as ok, 0::bigint as score, (case when s_nationkey % 4 between 1 and 2 then 0 else 1 end)::bigint as n_errors from supplier")
def constraints_array(spark, sf_dir):
    schema = {"type": "array", "items": {"type": "integer", "minimum": 0}, "minItems": 1, "maxItems": 2}
    text = F.concat(F.lit("["), F.array_join(F.slice(F.array(*[F.lit(str(i)) for i in range(3)]), F.lit(1), (F.col("s_nationkey") % 4).cast("int")), ","), F.lit("]"))
    return _outcome(_run(_table(spark, sf_dir, "supplier"), schema, text), "s_suppkey", F.size("r.errors").cast("long").alias("n_errors"))


@_query(
    "select o_orderkey, month(o_orderdate) + o_orderkey % 3 <= 12 as date_ok, day(o_orderdate) + o_orderkey % 200 <= 255 as ip_ok, o_orderkey % 2 = 0 as mail_ok from orders"
)
def formats(spark, sf_dir):
    """Dates, addresses and mail names, each sometimes wrong."""
    schema = _object(day={"type": "string", "format": "date"}, ip={"type": "string", "format": "ipv4"}, mail={"type": "string", "format": "email"})
    day = F.format_string("%d-%02d-%02d", F.year("o_orderdate"), (F.month("o_orderdate") + F.col("o_orderkey") % 3).cast("int"), F.lit(28))
    ip = F.format_string("10.0.1.%d", (F.dayofmonth("o_orderdate") + F.col("o_orderkey") % 200).cast("int"))
    mail = F.concat(F.format_string("c%d", "o_custkey"), F.when(F.col("o_orderkey") % 2 == 0, "@mail.example.com").otherwise("@mail..example.com"))
    text = F.to_json(F.struct(day.alias("day"), ip.alias("ip"), mail.alias("mail")))
    df = _run(_table(spark, sf_dir, "orders"), schema, text)
    fine = lambda name: ~F.exists(F.col("r.errors"), lambda e: e.startswith(f"{name}: "))
    return df.select("o_orderkey", fine("day").alias("date_ok"), fine("ip").alias("ip_ok"), fine("mail").alias("mail_ok"))


@_query("select c_custkey, c_acctbal >= 0 as ok, case when c_acctbal < 0 then 'balance is overdrawn' end as error, 0::bigint as score from customer")
def custom_rules(spark, sf_dir):
    rule = lambda v: "balance is overdrawn" if v["balance"] < 0 else True
    text = F.concat(F.lit('{"balance": '), F.col("c_acctbal").cast("string"), F.lit("}"))
    df = _run(_table(spark, sf_dir, "customer"), _object(balance=REAL), text, rules=(rule,))
    return _outcome(df, "c_custkey", F.when(F.size("r.errors") > 0, F.col("r.errors")[0]).alias("error"))


@_query(
    "select o_orderkey, o_totalprice as price, o_totalprice < 200000 and o_orderstatus <> 'P' as ok, (case when o_totalprice < 200000 then 0 else 1 end + case when o_orderstatus <> 'P' then 0 else 1 end)::bigint as n_errors, "
    "case when o_totalprice >= 200000 then 'dear' when o_orderstatus = 'P' then 'pending ' || o_orderkey end as first_error, 0::bigint as total from orders"
)
def column_rules(spark, sf_dir):
    """Rules as columns, with another column of the row; the score again as the sum of penalties."""
    df = _run(_table(spark, sf_dir, "orders"), REAL, F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    rules = [(F.col("r.data") < 200000, "dear"), (F.col("o_orderstatus") != "P", F.concat(F.lit("pending "), F.col("o_orderkey").cast("string")))]
    r = ruled("r", rules)
    return df.select("o_orderkey", F.col("r.data").alias("price"), r["ok"].alias("ok"), F.size(r["errors"]).cast("long").alias("n_errors"), F.get(r["errors"], F.lit(0)).alias("first_error"), score_of("r.flags").alias("total"))


@_query(
    "select n_nationkey, 'The following corrections were needed:' || chr(10) || '  - Ignored extra key \"name\"' || chr(10) || '  - Used default value (required field missing)' || chr(10) || chr(10) "
    "|| 'Please respond using exactly this format:' || chr(10) || 'Answer in JSON using this schema:' || chr(10) || '{' || chr(10) || '  region: int,' || chr(10) || '}' as told from nation"
)
def feedback_text(spark, sf_dir):
    own = Extractor({"type": "object", "properties": {"region": WHOLE}, "required": ["region"]})
    df = _table(spark, sf_dir, "nation").withColumn("r", own.column(F.format_string('{"name": "%s"}', "n_name")))
    return df.select("n_nationkey", feedback("r", own.prompt()).alias("told"))


@_query(
    "select user_id, event_id, score from (select user_id, event_id, value as score, row_number() over (partition by user_id order by event_type = 'error', event_type = 'view', value, event_id) as k from events) where k = 1"
)
def best_of_candidates(spark, sf_dir):
    """The ranking of candidates as an aggregate."""
    df = _table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("is_default"), (F.col("event_type") == "view").alias("is_guess"), F.col("value").alias("score"))
    return best_candidate(df, ["user_id"], "is_default", "is_guess", "score", "event_id").select("user_id", "event_id", "score")


@_query(
    "select n_nationkey, part, case part when 1 then n_name when 2 then n_name else n_name end as name, case part when 3 then n_regionkey::bigint end as region, "
    "(case part when 1 then 100 when 2 then 100 else 0 end)::bigint as score, case part when 3 then true end as done from nation, (select unnest([1, 2, 3]) as part)"
)
def stream_replay(spark, sf_dir):
    """Partial results after each of three chunks."""
    nation = _table(spark, sf_dir, "nation")
    chunks = F.array(
        F.struct(F.lit(1).alias("part"), F.format_string('{"name": "%s"', "n_name").alias("chunk")),
        F.struct(F.lit(2).alias("part"), F.lit(', "region":').alias("chunk")),
        F.struct(F.lit(3).alias("part"), F.concat(F.lit(" "), F.col("n_regionkey").cast("string"), F.lit("}")).alias("chunk")),
    )
    parts = nation.select("n_nationkey", F.explode(chunks).alias("c")).select("n_nationkey", "c.part", "c.chunk")
    out = replay(parts, Extractor(_object(name=TEXT, region=WHOLE)), "n_nationkey", "part", "chunk")
    return out.select("n_nationkey", "part", "partial.data.name", "partial.data.region", F.col("partial.score").alias("score"), F.col("final.ok").alias("done"))


@_query("select conv_id, turn, string_agg(role, '') over w as data, (count(*) over (partition by conv_id order by turn rows between 1 following and unbounded following)) = 0 as is_last from conversations window w as (partition by conv_id order by turn rows unbounded preceding)")
def stream_conversations(spark, sf_dir):
    """Texts that grow turn by turn; a string takes any of them."""
    talk = _table(spark, sf_dir, "conversations")
    out = replay(talk.select("conv_id", "turn", "role"), Extractor(TEXT), "conv_id", "turn", "role")
    return out.select("conv_id", "turn", F.col("partial.data").alias("data"), F.col("final").isNotNull().alias("is_last"))


@_query(
    "select event_type, count(*) as n, avg(case when json_extract(props, '$.k')::bigint >= 20 then 1.0 else 0.0 end)::double as ok_rate, 1.0::double as mean_score, count(*) as n_strings from events group by 1"
)
def quality_by_type(spark, sf_dir):
    text = F.concat(F.lit('{"k": "'), F.get_json_object("props", "$.k"), F.lit('"}'))
    df = _run(_table(spark, sf_dir, "events"), _object(k={"type": "integer", "minimum": 20}), text)
    return quality_rollup(df, "r", "event_type").select("event_type", "n", "ok_rate", "mean_score", F.col("flag_counts")["string-to-float"].alias("n_strings"))


@_query("select o_orderkey, o_totalprice as price, 0::bigint as score from orders where o_orderstatus <> 'P'")
def drop_malformed(spark, sf_dir):
    """Rows whose text fits nothing or breaks a constraint are dropped."""
    schema = {"type": "number", "exclusiveMinimum": 0}
    text = F.when(F.col("o_orderstatus") == "P", F.lit("no price yet")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    df = _table(spark, sf_dir, "orders").withColumn("text", text).transform(Extractor(schema).into("text", "r", "DROPMALFORMED"))
    return df.select("o_orderkey", F.col("r.data").alias("price"), "r.score")


@_query("select o_orderkey, o_orderstatus as status, 'order' as kind, true as ok, 1::bigint as score from orders")
def literal_fields(spark, sf_dir):
    schema = _object(kind={"const": "order"}, version={"const": 3}, status=TEXT)
    text = F.format_string('{"kind": "order", "version": "3.0 beta", "status": "%s"}', "o_orderstatus")
    return _outcome(_run(_table(spark, sf_dir, "orders"), schema, text), "o_orderkey", "r.data.kind", "r.data.status")


@_query("select l_orderkey, l_linenumber, l_suppkey, l_partkey, 3::bigint as n, l_quantity as q, true as ok, 0::bigint as score from lineitem")
def nested_lineitem(spark, sf_dir):
    """Records in lists in records, in a fence."""
    item = _object(id=WHOLE, qty=REAL)
    schema = _object(order=WHOLE, items={"type": "array", "items": item})
    one = '{"id": %d, "qty": %s}'
    text = F.format_string(f'```\n{{"order": %d, "items": [{one}, {one}, {one}]}}\n```', "l_orderkey", "l_partkey", F.col("l_quantity").cast("string"), "l_suppkey", F.lit("1.5"), "l_linenumber", F.lit("2"))
    df = _run(_table(spark, sf_dir, "lineitem"), schema, text)
    return _outcome(df, "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.size("r.data.items").cast("long").alias("n"), F.col("r.data.items")[0]["qty"].alias("q"))


@_query("select p_partkey, p_name as name, 1::bigint as n, true as ok, 2::bigint as score from part")
def implied_key(spark, sf_dir):
    """A bare value for a record of one field."""
    df = _run(_table(spark, sf_dir, "part"), _object(names={"type": "array", "items": TEXT}), F.format_string('["%s"]', "p_name"))
    return _outcome(df, "p_partkey", F.col("r.data.names")[0].alias("name"), F.size("r.data.names").cast("long").alias("n"))


@_query(
    "select r_regionkey, ord, wrapper, tag, value from (select r_regionkey, 0::int as ord, 'fenced' as wrapper, 'json' as tag, '{r: ' || r_name || '}' as value from region "
    "union all select r_regionkey, 1, 'fenced', 'text', 'plain ' || r_name from region union all select r_regionkey, 2, 'plain', null, '[json' || chr(10) || '{r: ' || r_name || '}, text' || chr(10) || 'plain ' || r_name || ']' from region)"
)
def candidates_udtf(spark, sf_dir):
    """All readings of a text as rows, in SQL."""
    register(spark, {"extract_region": Extractor(_object(r=TEXT))})
    text = F.concat(F.lit('```json\n{"r": "'), F.col("r_name"), F.lit('"}\n```\nand\n```text\nplain '), F.col("r_name"), F.lit("\n```"))
    _table(spark, sf_dir, "region").select("r_regionkey", text.alias("text")).createOrReplaceTempView("structcast_region_texts")
    return spark.sql("select r_regionkey, c.ord, c.wrapper, c.tag, c.value from structcast_region_texts, lateral parse_candidates(text) c")


@_query("select r_regionkey, r_name as name, 0::bigint as score from region")
def sql_function(spark, sf_dir):
    register(spark, {"extract_region": Extractor(_object(r=TEXT))})
    _table(spark, sf_dir, "region").createOrReplaceTempView("structcast_regions")
    return spark.sql("""select r_regionkey, x.data.r as name, x.score from (select r_regionkey, extract_region(concat('{r: "', r_name, '"')) as x from structcast_regions)""")


TREE = {"$defs": {"Node": {"type": "object", "properties": {"v": WHOLE, "left": {"anyOf": [{"$ref": "#/$defs/Node"}, {"type": "null"}]}}, "required": ["v"]}}, "$ref": "#/$defs/Node"}


@_query("select n_nationkey, n_regionkey::bigint as v, '{\"v\":' || n_nationkey || ',\"left\":null}' as left_json, true as ok, 1::bigint as score from nation")
def recursion_tree(spark, sf_dir):
    text = F.format_string('{"v": %d, "left": {"v": %d}}', "n_regionkey", "n_nationkey")
    return _outcome(_run(_table(spark, sf_dir, "nation"), TREE, text), "n_nationkey", "r.data.v", F.col("r.data.left").alias("left_json"))


@_query(
    "select event_id, case when event_type = 'error' then '{\"type\":\"error\",\"message\":\"' || event_type || '\"}' else '{\"type\":\"success\",\"user\":' || user_id || '}' end as answer, true as ok, 0::bigint as score from events"
)
def union_of_classes(spark, sf_dir):
    """Records told apart by a constant."""
    schema = {"anyOf": [_object(type={"const": "success"}, user=WHOLE), _object(type={"const": "error"}, message=TEXT)]}
    text = F.when(F.col("event_type") == "error", F.format_string('{"type": "error", "message": "%s"}', "event_type")).otherwise(F.format_string('{"type": "success", "user": %d}', "user_id"))
    return _outcome(_run(_table(spark, sf_dir, "events"), schema, text), "event_id", F.col("r.data").alias("answer"))


@_query("select item_id, text as data, true as ok, 0::bigint as score from benchmark")
def plain_prose(spark, sf_dir):
    """Prose for a string is the prose."""
    return _outcome(_run(_table(spark, sf_dir, "benchmark"), TEXT, F.col("text")), "item_id", F.col("r.data").alias("data"))


@_query("select r_regionkey, null::varchar as name, false as ok, null::bigint as score from region")
def options_off(spark, sf_dir):
    """Without fences, embedded JSON and repair only strict JSON is read."""
    own = Extractor({"type": "object", "additionalProperties": TEXT}, options=Options(fences=False, embedded=False, repair=False))
    df = _table(spark, sf_dir, "region").withColumn("r", own.column(F.format_string("Answer: {name: '%s'}", "r_name")))
    return _outcome(df, "r_regionkey", F.col("r.data")["name"].alias("name"))


BUILT = Target(Record("Tag", (Field("label", STRING, alias="tag-label"), Field("ranks", ListOf(OneOf((INT, NULL))), optional=True), Field("more", MapOf(STRING, STRING), optional=True))))


@_query("select n_nationkey, n_name as label, 2::bigint as n, true as ok, 1::bigint as score from nation")
def built_shapes(spark, sf_dir):
    """A target built by hand, with an alias."""
    df = _run(_table(spark, sf_dir, "nation"), BUILT, F.format_string('{"tag label": "%s", "ranks": [%d, null]}', "n_name", "n_regionkey"))
    return _outcome(df, "n_nationkey", "r.data.label", F.size("r.data.ranks").cast("long").alias("n"))


@_query(
    "select p_partkey, p_size > 5 and p_size < 40 as ok, coalesce(case when p_size <= 5 then 'size: Value ' || p_size || ' is not greater than exclusive minimum 5' "
    "when p_size >= 40 then 'size: Value ' || p_size || ' is not less than exclusive maximum 40' end, '') as errors, 0::bigint as score from part"
)
def exclusive_bounds(spark, sf_dir):
    schema = _object(size={"type": "integer", "exclusiveMinimum": 5, "exclusiveMaximum": 40})
    return _outcome(_run(_table(spark, sf_dir, "part"), schema, F.format_string('{"size": %d}', "p_size")), "p_partkey", F.array_join("r.errors", "; ").alias("errors"))


@_query(
    "select o_orderkey, o_orderkey % 30 < 24 as moment_ok, o_custkey % 26 < 24 and o_orderkey % 70 < 60 as time_ok, "
    "case when o_orderkey % 30 >= 24 then 'at: \"' || strftime(o_orderdate, '%Y-%m-%d') || 'T' || (o_orderkey % 30) || ':05:09Z\" is not a valid date-time' end as told from orders"
)
def moments(spark, sf_dir):
    """Dates with a time, and times, with hours and minutes that don't always exist."""
    schema = _object(at={"type": "string", "format": "date-time"}, hour={"type": "string", "format": "time"})
    at = F.format_string("%sT%02d:05:09Z", F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 30)
    hour = F.format_string("%02d:%02d:07", F.col("o_custkey") % 26, F.col("o_orderkey") % 70)
    df = _run(_table(spark, sf_dir, "orders"), schema, F.to_json(F.struct(at.alias("at"), hour.alias("hour"))))
    wrong = lambda name: F.get(F.filter(F.col("r.errors"), lambda e: e.startswith(f"{name}: ")), F.lit(0))
    return df.select("o_orderkey", wrong("at").isNull().alias("moment_ok"), wrong("hour").isNull().alias("time_ok"), wrong("at").alias("told"))


@_query(
    "select s_suppkey, s_suppkey % 2 = 0 as uri_ok, s_suppkey % 3 <> 0 as uuid_ok, s_suppkey % 5 <> 0 as ipv6_ok, "
    "(s_suppkey % 2)::bigint + (s_suppkey % 3 = 0)::bigint + (s_suppkey % 5 = 0)::bigint as n_errors from supplier"
)
def identifiers(spark, sf_dir):
    schema = _object(link={"type": "string", "format": "uri"}, id={"type": "string", "format": "uuid"}, host={"type": "string", "format": "ipv6"})
    n = F.col("s_suppkey")
    link = F.concat(F.when(n % 2 == 0, "https://example.org/").otherwise("no scheme/"), n.cast("string"))
    id_ = F.concat(F.lpad(F.hex(n.cast("long")), 8, "0"), F.lit("-12ab-4CDE-8f00-"), F.when(n % 3 != 0, "0123456789ab").otherwise("0123456789ag"))
    host = F.concat(F.lit("2001:db8::"), F.when(n % 5 != 0, F.lower(F.hex((n % 4096).cast("long")))).otherwise("12345"))
    df = _run(_table(spark, sf_dir, "supplier"), schema, F.to_json(F.struct(link.alias("link"), id_.alias("id"), host.alias("host"))))
    fine = lambda name: ~F.exists(F.col("r.errors"), lambda e: e.startswith(f"{name}: "))
    return df.select("s_suppkey", fine("link").alias("uri_ok"), fine("id").alias("uuid_ok"), fine("host").alias("ipv6_ok"), F.size("r.errors").cast("long").alias("n_errors"))


@_query(
    "select s_suppkey, (s_nationkey % 4)::bigint as n, s_nationkey % 4 in (1, 2) as ok, case s_nationkey % 4 when 0 then 'Object has 0 properties, minimum is 1' when 3 then 'Object has 3 properties, maximum is 2' end as error from supplier"
)
def property_counts(spark, sf_dir):
    schema = {"type": "object", "additionalProperties": WHOLE, "minProperties": 1, "maxProperties": 2}
    members = F.slice(F.array(*[F.lit(f'"k{i}": {i}') for i in range(3)]), F.lit(1), (F.col("s_nationkey") % 4).cast("int"))
    df = _run(_table(spark, sf_dir, "supplier"), schema, F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}")))
    return df.select("s_suppkey", F.size("r.data").cast("long").alias("n"), F.col("r.ok").alias("ok"), F.get("r.errors", F.lit(0)).alias("error"))


@_query("select c_custkey, case c_custkey % 3 when 0 then 'Crème brûlée' when 1 then 'Smørrebrød' else 'Weißwurst' end as dish, true as ok, 3::bigint as score from customer")
def enum_accents(spark, sf_dir):
    """Names told without their accents and ligatures."""
    schema = {"type": "string", "enum": ["Crème brûlée", "Smørrebrød", "Weißwurst"]}
    said = F.element_at(F.array(*map(F.lit, ("Creme brulee", "Smorrebrod", "Weisswurst"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return _outcome(_run(_table(spark, sf_dir, "customer"), schema, said), "c_custkey", F.col("r.data").alias("dish"))


@_query("select n_nationkey, 'say \"' || n_name || '\"' || chr(10) || 'twice' as quote, 'select ' || n_regionkey as code, true as ok, 0::bigint as score from nation")
def block_strings(spark, sf_dir):
    """Strings in three quotes and in three backticks."""
    text = F.concat(F.lit('{quote: """say "'), F.col("n_name"), F.lit('"\ntwice""", code: ```sql\nselect '), F.col("n_regionkey").cast("string"), F.lit("```}"))
    return _outcome(_run(_table(spark, sf_dir, "nation"), _object(quote=TEXT, code=TEXT), text), "n_nationkey", "r.data.quote", "r.data.code")


@_query("select n_nationkey, n_regionkey::bigint as a, 4::bigint as n, n_name as last, true as ok, 2::bigint as score from nation")
def repaired_array(spark, sf_dir):
    """An array of bare and quoted words, cut before its end; its number becomes text."""
    text = F.format_string("[one, 'two', %d, \"%s", "n_regionkey", "n_name")
    df = _run(_table(spark, sf_dir, "nation"), {"type": "array", "items": TEXT}, text)
    return _outcome(df.withColumn("x", F.col("r.data")), "n_nationkey", F.size("x").cast("long").alias("n"), F.element_at("x", -1).alias("last"), F.get("x", F.lit(2)).cast("long").alias("a"))


@_query("select event_id, case when event_id % 3 = 0 then null else user_id end as u, true as ok, (case event_id % 3 when 2 then 1 else 0 end)::bigint as score from events")
def type_list(spark, sf_dir):
    """Several types in one keyword."""
    value = F.when(F.col("event_id") % 3 == 0, F.lit("null")).when(F.col("event_id") % 3 == 1, F.col("user_id").cast("string")).otherwise(F.format_string('"%d"', "user_id"))
    return _outcome(_run(_table(spark, sf_dir, "events"), _object(u={"type": ["integer", "null"]}), F.concat(F.lit('{"u": '), value, F.lit("}"))), "event_id", "r.data.u")


@_query("select s_suppkey, '[1]' as item_path, 'bad' as entry_path, true as told from supplier")
def flag_paths(spark, sf_dir):
    """Where in the value a part didn't fit."""
    schema = _object(xs={"type": "array", "items": WHOLE}, m={"type": "object", "additionalProperties": WHOLE})
    df = _run(_table(spark, sf_dir, "supplier"), schema, F.format_string('{"xs": [%d, "nothing"], "m": {"good": 1, "bad": "nothing"}}', "s_suppkey"))
    path = lambda kind: F.get(F.filter(F.col("r.flags"), lambda f: f["kind"] == kind), F.lit(0))
    return df.select("s_suppkey", path("array-item-parse-error")["path"].alias("item_path"), path("map-value-parse-error")["path"].alias("entry_path"), (F.length(path("array-item-parse-error")["message"]) > 0).alias("told"))


@_query("select n_nationkey, '[' || n_nationkey || ',\"' || n_name || '\",' || n_regionkey || ']' as xs, true as ok, 0::bigint as score from nation")
def list_of_unions(spark, sf_dir):
    """Items of a list by turns of either type; each item's option is tried first for the next."""
    df = _run(_table(spark, sf_dir, "nation"), _object(xs={"type": "array", "items": {"anyOf": [WHOLE, TEXT]}}), F.format_string('{"xs": [%d, "%s", %d]}', "n_nationkey", "n_name", "n_regionkey"))
    return _outcome(df, "n_nationkey", F.concat(F.lit("["), F.array_join("r.data.xs", ","), F.lit("]")).alias("xs"))


@_query("select o_orderkey, o_totalprice as price from orders where o_totalprice >= 1000")
def asserted_prices(spark, sf_dir):
    """Results that must be ok: a single one that isn't would fail the query."""
    schema = {"type": "number", "minimum": 1000}
    dear = _table(spark, sf_dir, "orders").where("o_totalprice >= 1000").withColumn("text", F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return dear.transform(Extractor(schema).into("text", "r", "FAILFAST")).select("o_orderkey", F.col("r.data").alias("price"))


@_query("select n_nationkey, part, case part when 1 then n_nationkey end as first, part = 2 as is_last, case part when 2 then true end as done from nation, (select unnest([1, 2]) as part)")
def stream_options(spark, sf_dir):
    """A stream without the checks of its extractor: values under the minimum are ok at the end."""
    chunks = F.array(F.struct(F.lit(1).alias("part"), F.format_string('{"n": %d', "n_nationkey").alias("chunk")), F.struct(F.lit(2).alias("part"), F.lit("}").alias("chunk")))
    parts = _table(spark, sf_dir, "nation").select("n_nationkey", F.explode(chunks).alias("c")).select("n_nationkey", "c.part", "c.chunk")
    out = replay(parts, Extractor(_object(n={"type": "integer", "minimum": 1000})), "n_nationkey", "part", "chunk", checks=False)
    return out.select("n_nationkey", "part", F.when(F.col("part") == 1, F.col("partial.data.n")).alias("first"), F.col("final").isNotNull().alias("is_last"), F.col("final.ok").alias("done"))


_KINDS = Target(
    Record(
        "Order",
        (
            Field("kind", Choice("Kind", (Member("A", description="first"), Member("B"))), description="what it is"),
            Field("tags", ListOf(STRING), optional=True),
            Field("counts", MapOf(STRING, INT)),
            Field("either", OneOf((INT, STRING, NULL))),
        ),
    )
)
_KINDS_TEXT = "Kind\n----\n- A: first\n- B\n\nAnswer in JSON using this schema:\n{\n  kind: Kind, // what it is\n  tags: string[] | null,\n  counts: map<string, int>,\n  either: int or string | null,\n}"
_STYLED_TEXT = 'Kind\n----\n* A: first\n* B\nOrder {\n  "kind": Kind, // what it is\n  "tags": string[] | null,\n  "counts": {[key: string]: int},\n  "either": int | string | null,\n}\n\nGo.\nOrder'


@_query("select r_regionkey, $$" + _KINDS_TEXT + "$$ as usual, $$" + _STYLED_TEXT + "$$ as styled from region")
def prompt_styles(spark, sf_dir):
    """Hoisted choices, records, optional fields, lists, maps and unions, in the usual style and another."""
    other = Style(opening="Go.", either=" | ", member="* ", hoist_records=True, quote_fields=True, map_style="object")
    return _table(spark, sf_dir, "region").select("r_regionkey", F.lit(Extractor(_KINDS).prompt()).alias("usual"), F.lit(Extractor(_KINDS, style=other).prompt()).alias("styled"))
