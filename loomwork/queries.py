"""Queries over the driver's tables, one for each kind of record work, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import fields as catalog
from .functions import arithmetic as ar
from .functions import encoding as en
from .functions import frames as fr
from .functions import json_policy as js
from .functions import lists as li
from .functions import records as re_
from .operators import canonical as ca
from .operators import ordering as od
from .operators import workloads as wl
from .plans.staging import shared_dir
from .streaming import flow

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EVENT_TYPES = ["click", "view", "purchase"]
_TYPES_SQL = "['click', 'view', 'purchase']"


# Nested valuation, re-ranking, expression trees, summaries


@query("""
SELECT l_orderkey, sum(200 + l_linenumber * 350 + CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT) + CASE WHEN l_returnflag = 'R' THEN 100 ELSE 0 END
  + (CAST(l_quantity AS BIGINT) * 10 * 7) // 50 + CAST(l_quantity AS BIGINT) * 40
  + CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_returnflag = 'N' THEN 5000 ELSE 3000 END ELSE 0 END
  + CASE WHEN l_returnflag = 'A' THEN 100 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 200 ELSE 0 END + CASE WHEN l_returnflag = 'N' THEN 400 ELSE 0 END
  + CASE WHEN l_linestatus = 'F' THEN 2000 ELSE 0 END + l_linenumber * 25)::BIGINT AS amount
FROM lineitem GROUP BY l_orderkey""")
def nested_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    car = F.struct(
        F.lit(1).alias("seats"), F.col("l_linenumber").alias("doors"), F.array(F.struct(q.alias("diameter"), (flag == "R").alias("snowTires"))).alias("wheels"),
        q.alias("length"), F.lit(10).alias("width"), F.lit(7).alias("height"),
        F.struct(q.alias("horsepower"), (flag == "N").alias("usesGas"), (status == "O").alias("usesElectric")).alias("engine"),
        (flag == "A").alias("hasPowerWindows"), (flag == "R").alias("hasPowerSteering"), (flag == "N").alias("hasCruiseControl"), (status == "F").alias("hasNavSystem"),
        F.col("l_linenumber").alias("cupHolders"),
    )
    cars = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(car).alias("cars"))
    return cars.select("l_orderkey", wl.total_value(F.col("cars")).alias("amount"))


_RESCORED = "n_chars::DOUBLE * (CASE WHEN contains(text, ' the ') THEN 10000.0::DOUBLE ELSE 1 END) / (CASE WHEN contains(text, ' de ') THEN 10000.0::DOUBLE ELSE 1 END)"


@query(f"SELECT doc_id, score, (row_number() OVER (ORDER BY score DESC, doc_id) - 1)::BIGINT AS position FROM (SELECT doc_id, {_RESCORED} AS score FROM documents)")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", wl.rescored(F.col("n_chars").cast("double"), F.col("text"), " the ", " de ").alias("score"))
    return od.positions(d, F.desc("score"), F.col("doc_id"))


@query(f"SELECT count(*)::BIGINT AS leading FROM (SELECT {_RESCORED} AS score FROM documents) WHERE score > 1001")
def rerank_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the ranked results come before the first score of 1001 or less."""
    d = table(spark, sf_dir, "documents").select(wl.rescored(F.col("n_chars").cast("double"), F.col("text"), " the ", " de ").alias("score"))
    return d.agg(F.count_if(F.col("score") > 1001).alias("leading"))


@query("""
WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS v,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
  steps AS (SELECT l_orderkey, k, n, v AS acc FROM l WHERE k = 1
    UNION ALL SELECT s.l_orderkey, l.k, s.n,
      CASE l.k % 5 WHEN 0 THEN ((s.acc + l.v + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648
        WHEN 1 THEN ((s.acc - l.v + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648
        WHEN 2 THEN ((s.acc * l.v + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648
        WHEN 3 THEN s.acc // l.v ELSE s.acc % l.v END
    FROM steps s JOIN l ON l.l_orderkey = s.l_orderkey AND l.k = s.k + 1)
SELECT l_orderkey AS tree, acc::INTEGER AS value FROM steps WHERE k = n""")
def expr_tree_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a tree: the first quantity, then one operation a line."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree"), F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"), F.col("l_quantity").cast("int").alias("v"))
    k, n = F.col("k"), F.col("n")
    kind = "struct<node:int,parent:int,side:string,op:string,value:int>"
    null = F.lit(None)
    # Leaf k hangs on operation k (its right side; the first leaf is operation 2's left), which hangs on k + 1.
    leaf = F.struct((k * 2).alias("node"), F.when(n > 1, F.greatest(k, F.lit(2)) * 2 + 1).alias("parent"), F.when(n > 1, F.when(k == 1, "left").otherwise("right")).alias("side"), null.alias("op"), F.col("v").alias("value")).cast(kind)
    name = F.get(F.array(*(F.lit(o) for o in wl.OPERATIONS)), k % 5)
    inner = F.struct((k * 2 + 1).alias("node"), F.when(k < n, k * 2 + 3).alias("parent"), F.when(k < n, F.lit("left")).alias("side"), name.alias("op"), null.alias("value")).cast(kind)
    nodes = lines.select("tree", F.explode(F.when(k == 1, F.array(leaf)).otherwise(F.array(leaf, inner))).alias("x")).select("tree", "x.*")
    return wl.evaluate_trees(nodes).select("tree", "value")


@query("""
SELECT o_orderkey, concat_ws('|', o_orderkey::VARCHAR, o_orderstatus, o_orderpriority, coalesce(lines, ''),
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open=' || o_orderpriority ELSE 'unknown=' || o_orderstatus END) AS summary
FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber::VARCHAR || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("lines"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    items = F.coalesce(F.transform("lines", lambda x: F.concat_ws(":", x.l_linenumber.cast("string"), x.l_returnflag)), F.array().cast("array<string>"))
    status = F.col("o_orderstatus")
    tail = F.when(status == "F", F.lit("done")).when(status == "O", F.concat(F.lit("open="), F.col("o_orderpriority"))).otherwise(F.concat(F.lit("unknown="), status))
    return o.select("o_orderkey", wl.summary(F.col("o_orderkey"), status, F.col("o_orderpriority"), items=items, tail=tail).alias("summary"))


@query("""
WITH RECURSIVE l AS (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
  steps AS (SELECT l_orderkey, k, v * 2.0 AS r FROM l WHERE k = 1
    UNION ALL SELECT s.l_orderkey, l.k, CASE l.k % 3 WHEN 0 THEN s.r - l.v WHEN 1 THEN s.r * l.v ELSE s.r / l.v END FROM steps s JOIN l ON l.l_orderkey = s.l_orderkey AND l.k = s.k + 1)
SELECT l_orderkey AS calc, k::INTEGER AS step, r AS result FROM steps""")
def calculator_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a calculation whose steps take the result of the step before."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    k = F.row_number().over(w)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("calc"), k.alias("step"), F.col("l_quantity").cast("double").alias("v"))
    s = F.col("step")
    op = F.when(s == 1, "multiply").otherwise(F.get(F.array(*(F.lit(x) for x in ("subtract", "multiply", "divide"))), s % 3))
    side = lambda value, ref: F.struct(value.cast("double").alias("value"), ref.cast("int").alias("ref"))
    first, none = s == 1, F.lit(None)
    return wl.calculate(lines.select("calc", "step", op.alias("op"), side(F.when(first, F.col("v")), F.when(~first, s - 1)).alias("left"), side(F.when(first, 2.0).otherwise(F.col("v")), none).alias("right")))


# Arithmetic and text


_WRAP = "((({0}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648"


@query(f"""
WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) * 1000003 % 4294967296 - 2147483648 AS a, CASE l_linenumber WHEN 1 THEN -1 WHEN 2 THEN 0 ELSE l_suppkey * 7919 END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, ({_WRAP.format('a + b')})::INTEGER AS added, ({_WRAP.format('a - b')})::INTEGER AS subtracted, ({_WRAP.format('a * b')})::INTEGER AS multiplied,
  (CASE WHEN b = 0 OR (a = -2147483648 AND b = -1) THEN 2147483647 ELSE a // b END)::INTEGER AS divided,
  (CASE WHEN b = 0 OR (a = -2147483648 AND b = -1) THEN 2147483647 ELSE a % b END)::INTEGER AS remainder FROM x""")
def guarded_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.pmod(F.col("l_partkey") * 1000003, F.lit(1 << 32)) - F.lit(1 << 31)).cast("int").alias("a"),
        F.when(F.col("l_linenumber") == 1, -1).when(F.col("l_linenumber") == 2, 0).otherwise(F.col("l_suppkey") * 7919).cast("int").alias("b"),
    )
    a, b = F.col("a"), F.col("b")
    return x.select("l_orderkey", "l_linenumber", ar.wrapping_add(a, b).alias("added"), ar.wrapping_subtract(a, b).alias("subtracted"), ar.wrapping_multiply(a, b).alias("multiplied"), ar.safe_divide(a, b).alias("divided"), ar.safe_modulus(a, b).alias("remainder"))


@query("""
SELECT o_orderkey, o_orderkey AS from_hex, -o_orderkey AS negative, o_custkey * 1000 + 7 AS grouped,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Infinity'::DOUBLE ELSE o_totalprice END AS real, NULL::BIGINT AS refused, o_custkey AS plus, NULL::BIGINT AS upper_prefix, o_custkey * 1000 + 0.5::DOUBLE AS grouped_real FROM orders""")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        ar.parse_unsigned(F.concat(F.lit("0x"), F.hex("o_orderkey"))).cast("long").alias("from_hex"),
        ar.parse_signed(F.concat(F.lit("-"), k.cast("string"))).alias("negative"),
        ar.parse_unsigned(F.concat(F.col("o_custkey").cast("string"), F.lit("_007"))).cast("long").alias("grouped"),
        ar.parse_float(F.when(k % 3 == 0, F.lit("+INF")).otherwise(F.col("o_totalprice").cast("string"))).alias("real"),
        ar.parse_signed(F.concat(k.cast("string"), F.lit(", other = 2"))).alias("refused"),
        ar.parse_signed(F.concat(F.lit("+"), "o_custkey")).alias("plus"), ar.parse_unsigned(F.concat(F.lit("0X"), "o_custkey")).cast("long").alias("upper_prefix"),
        ar.parse_float(F.concat("o_custkey", F.lit("_000.5"))).alias("grouped_real"),
    )


@query(r"""
WITH o AS (SELECT o_orderkey, regexp_replace(printf('%.2f', o_totalprice), '\.?0+$', '') AS price, (o_orderkey + 1)::VARCHAR AS k FROM orders)
SELECT o_orderkey, price, k || repeat('0', 17) AS large, 'nan' AS nothing, '-0' AS zero, price AS price_json,
  k[1] || CASE WHEN length(rtrim(k, '0')) > 1 THEN '.' || rtrim(k, '0')[2:] ELSE '' END || 'e' || (length(k) + 24)::VARCHAR AS huge_json FROM o""")
def format_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("o_orderkey") + 1).cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", en.float_text(F.col("o_totalprice")).alias("price"), en.float_text(F.concat(k, F.lit("e17")).cast("double")).alias("large"),
        en.float_text(F.lit(float("nan"))).alias("nothing"), en.float_text(F.lit(-0.0)).alias("zero"), en.float_json(F.col("o_totalprice")).alias("price_json"),
        en.float_json(F.concat(k, F.lit("e25")).cast("double")).alias("huge_json"),
    )


_QUOTED_SQL = r"""'"' || replace(replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), '''', '\'''), chr(10), '\n'), chr(1), '\001') || '"'"""


@query(f"SELECT doc_id, {_QUOTED_SQL.format('text || chr(1)')} AS quoted, md5(text || chr(1)) AS returned_md5, 'aÿ' || chr(10) AS escapes, 0 AS refused FROM documents")
def quote_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a control character, and what comes back from the quotes."""
    text = F.concat("text", F.lit("\x01"))
    d = table(spark, sf_dir, "documents").select("doc_id", en.quote(text).alias("quoted"))
    return d.select("doc_id", "quoted", F.md5(en.unquote(F.col("quoted"))).alias("returned_md5"), en.unquote(F.lit(r'"\x61\303\277\n"')).alias("escapes"), F.coalesce(F.length(en.unquote(F.lit(r'"\9"'))), F.lit(0)).alias("refused"))


@query("SELECT doc_id, to_base64(encode(text)) AS encoded, md5(text) AS returned_md5, NULL::BLOB AS refused FROM documents")
def base64_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = en.to_base64(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", coded.alias("encoded"), F.md5(en.from_base64(coded)).alias("returned_md5"), en.from_base64(F.concat(coded, F.lit("="))).alias("refused"))


@query("SELECT doc_id, lower(hex(encode(text))) AS encoded, md5(text) AS returned_md5, NULL::BLOB AS refused FROM documents")
def hex_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = en.to_hex(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", coded.alias("encoded"), F.md5(en.from_hex(coded)).alias("returned_md5"), en.from_hex(F.concat(coded, F.lit("a"))).alias("refused"))


@query("SELECT doc_id, ascii(right(text, 1)) < 128 AS cut_valid, doc_id % 3 <> 1 AS changed_valid FROM documents")
def utf8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts less their last byte are valid where that is the last character; with a byte of a
    longer character at their end, which every third one gets, they are not."""
    text = F.col("text").cast("binary")
    changed = F.concat(text, F.when(F.col("doc_id") % 3 == 0, F.lit(b"\xc3\xa9")).when(F.col("doc_id") % 3 == 1, F.lit(b"\xc3")).otherwise(F.lit(b"")))
    cut = F.substr(text, F.lit(1), F.octet_length(text) - 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.is_valid_utf8(cut.cast("string")).alias("cut_valid"), F.is_valid_utf8(changed.cast("string")).alias("changed_valid"))


@query("""
WITH h AS (SELECT n_nationkey, md5('f00dfeedf00dfeed' || n_name) AS h FROM nation)
SELECT n_nationkey, CASE WHEN h[1] < '8' THEN ['8','9','a','b','c','d','e','f'][h[1]::INTEGER + 1] ELSE h[1] END || h[2:16] AS type_id FROM h""")
def derived_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", catalog.child_id(F.lit("f00dfeedf00dfeed"), F.col("n_name")).alias("type_id"))


# Unions, enums, defaults, presence, editing


@query(f"SELECT event_id, (user_id % 5)::INTEGER AS ordinal, {_TYPES_SQL}[(user_id % 5) + 1] AS name FROM events")
def enum_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", re_.enum_value(F.col("user_id") % 5, EVENT_TYPES).alias("e")).select("event_id", "e.ordinal", "e.name")


@query("""
WITH t AS (SELECT *, (user_id % 4)::INTEGER AS tag FROM events)
SELECT event_id, tag, CASE WHEN tag = 1 THEN user_id END AS number, CASE WHEN tag = 2 THEN event_type END AS word,
  CASE tag WHEN 0 THEN 'none' WHEN 1 THEN 'number' WHEN 2 THEN 'word' ELSE 'unknown(' || tag || ')' END AS active, tag = 0 AS none_present,
  2 AS set_tag, 'e' || event_id AS set_word, NULL::BIGINT AS set_number FROM t""")
def union_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = re_.union_value(F.col("user_id") % 4, {"none": F.lit(None).cast("boolean"), "number": F.col("user_id"), "word": F.col("event_type")})
    e = table(spark, sf_dir, "events").select("event_id", u.alias("u"))
    e = e.withColumn("s", re_.set_arm(F.col("u"), ["none", "number", "word"], "word", F.concat(F.lit("e"), "event_id")))
    return e.select("event_id", "u.tag", "u.number", "u.word", re_.which(F.col("u"), ["none", "number", "word"]).alias("active"), re_.is_present(F.col("u.none"), F.col("u.tag"), 0).alias("none_present"), "s.tag", "s.word", "s.number").toDF("event_id", "tag", "number", "word", "active", "none_present", "set_tag", "set_word", "set_number")


@query("""
SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'label' ELSE 'unknown(2)' END AS kind, CASE user_id % 3 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN event_type END AS value FROM events""")
def discriminator(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = re_.union_value(F.col("user_id") % 3, {"amount": F.col("user_id"), "label": F.col("event_type")})
    return table(spark, sf_dir, "events").select("event_id", u.alias("u")).select("event_id", re_.with_discriminator(F.col("u"), ["amount", "label"]).alias("d")).select("event_id", "d.*")


@query("""
SELECT c_custkey, nullif(c_nationkey, 7) AS c_nationkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, xor(c_custkey, 123456) AS stored, c_custkey AS value, 123456::BIGINT AS absent FROM customer""")
def default_elision(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = re_.xor_default(F.col("c_custkey"), 123456)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", re_.unless_default(F.col("c_nationkey"), 7).alias("c_nationkey"), re_.unless_default(F.col("c_mktsegment"), "BUILDING").alias("c_mktsegment"),
        stored.alias("stored"), re_.xor_default(stored, 123456).alias("value"), re_.xor_default(F.lit(None).cast("long"), 123456).alias("absent"),
    )


@query("SELECT c_custkey, c_name AS detail_name, c_nationkey * 2 AS detail_inner_twice, c_mktsegment FROM customer")
def flatten_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct((F.col("c_nationkey") * 2).alias("twice")).alias("inner")).alias("detail"), "c_mktsegment")
    return re_.flatten_record(re_.flatten_record(c, "detail", "detail_"), "detail_inner", "detail_inner_")


@query("SELECT c_custkey, c_name AS by_name, c_nationkey AS by_index, c_name AS moved, true AS source_cleared, 99 AS changed, 'int' AS kind FROM customer")
def record_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by name and by index, a set, a clear, and a move from field to field."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.struct("c_name", "c_nationkey", F.lit(None).cast("string").alias("other")).alias("r"))
    schema = c.schema["r"].dataType
    c = c.withColumns({"m": re_.move_field(F.col("r"), "c_name", "other", "string"), "s": re_.set_fields(F.col("r"), c_nationkey=F.lit(99))})
    return c.select("c_custkey", F.col("r.c_name").alias("by_name"), re_.field_at(F.col("r"), schema, 1).alias("by_index"), F.col("m.other").alias("moved"), F.col("m.c_name").isNull().alias("source_cleared"), F.col("s.c_nationkey").alias("changed"), F.typeof("r.c_nationkey").alias("kind"))


# JSON


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_keys(props) <> ['k'] AS has_unknown, false AS repeated FROM events")
def json_decode_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("k", T.LongType())])
    e, p = table(spark, sf_dir, "events"), F.col("props")
    return e.select("event_id", js.decode(p, schema).getField("k").alias("k"), (F.size(js.unknown_fields(p, schema)) > 0).alias("has_unknown"), js.has_duplicate_keys(p).alias("repeated"))


@query("""
SELECT event_id, '{"eventId":"' || event_id || '","user":{"id":"' || user_id || '"' || CASE WHEN event_type <> 'view' THEN ',"type":"' || event_type || '"' ELSE '' END || '},"bytes":[' || ascii(event_type[1]) || ',' || ascii(event_type[2])
  || '],"none":[],"list":["1","' || user_id || '"],"parts":[{"n":' || (user_id % 9) || '},null],"half":' || (user_id // 2) || CASE WHEN user_id % 2 = 1 THEN '.5' ELSE '' END || ',"huge":' || CASE WHEN event_id % 9 = 0 THEN '0' ELSE (event_id % 9) || 'e25' END
  || ',"nothing":"NaN","name":"<' || event_type || '>"}' AS json FROM events""")
def json_encode_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records, lists, bytes, none of them, doubles, and a field with a handler of its own."""
    user = F.struct(F.col("user_id").alias("id"), re_.unless_default(F.col("event_type"), "view").alias("type"))
    part = F.struct((F.col("user_id") % 9).cast("int").alias("n"))
    r = F.struct(
        F.col("event_id").alias("eventId"), user.alias("user"), F.substring(F.col("event_type").cast("binary"), 1, 2).alias("bytes"), F.lit(b"").alias("none"), F.array(F.lit(1).cast("long"), F.col("user_id")).alias("list"),
        F.array(part, F.when(F.lit(False), part)).alias("parts"), (F.col("user_id") / 2).alias("half"), F.concat(F.col("event_id") % 9, F.lit("e25")).cast("double").alias("huge"), F.lit(float("nan")).alias("nothing"), F.col("event_type").alias("name"))
    e = table(spark, sf_dir, "events").select("event_id", r.alias("r"))
    return e.select("event_id", js.encode(F.col("r"), e.schema["r"].dataType, {"name": lambda x: F.concat(F.lit('"<'), x, F.lit('>"'))}).alias("json"))


@query("""
SELECT event_id, user_id AS number, NULL::BIGINT AS refused, NULL::BIGINT AS fraction, true AS flag, NULL::BOOLEAN AS quoted_flag, 9007199254740993::BIGINT AS exact, user_id / 4 AS real, 'Infinity'::DOUBLE AS endless, lower(hex(encode(event_type[1]))) || 'ff' AS data, NULL::VARCHAR AS beyond,
  event_type AS label, [1, NULL, (user_id % 7)::INTEGER] AS list, event_id % 2 = 0 AS accepted FROM events""")
def json_typed_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type takes its own forms: quoted integers, names of floats, arrays of bytes, nested records
    and lists. Anything beside the digits of an integer is refused, none goes through a float, and a
    field that comes twice spoils the record."""
    inner = T.StructType([T.StructField("label", T.StringType()), T.StructField("list", T.ArrayType(T.IntegerType()))])
    fields = [("number", T.LongType()), ("refused", T.LongType()), ("fraction", T.LongType()), ("flag", T.BooleanType()), ("quoted_flag", T.BooleanType()), ("exact", T.LongType()), ("real", T.DoubleType()), ("endless", T.DoubleType()), ("data", T.BinaryType()), ("beyond", T.BinaryType()), ("inner", inner)]
    schema = T.StructType([T.StructField(n, k) for n, k in fields])
    first = F.concat(F.encode(F.substring("event_type", 1, 1), "UTF-8"), F.lit(b"\xff"))
    given = F.struct(F.col("user_id").alias("number"), (F.col("user_id") / 4).alias("real"), first.alias("data"), F.struct((F.col("user_id") % 7).alias("list"), F.col("event_type").alias("label")).alias("inner"))
    e = table(spark, sf_dir, "events").select("event_id", given.alias("r"))
    forms = {"real": lambda x: x.cast("string"), "inner.list": lambda x: F.concat(F.lit('[1,"x","'), F.coalesce(x.cast("string"), F.lit("")), F.lit('"]'))}
    fixed = '{"refused":"1, other = 2","fraction":1.5,"flag":true,"quoted_flag":"true","exact":9007199254740993,"endless":"Infinity","beyond":[1,256],"unknown":[{}],'
    e = e.withColumn("t", F.concat(F.lit(fixed), F.substring(js.encode(F.col("r"), e.schema["r"].dataType, forms), 2, 1 << 30)))
    twice = F.when(F.col("event_id") % 2 != 0, F.replace("t", F.lit('"flag":true'), F.lit('"flag":true,"flag":false'))).otherwise(F.col("t"))
    e = e.select("event_id", js.decode(F.col("t"), schema).alias("d"), F.when(F.col("event_id").isNotNull(), js.decode(twice, schema).isNotNull()).alias("accepted"))
    return e.select("event_id", "d.*", "accepted").withColumns({"label": F.col("inner.label"), "list": F.col("inner.list"), "data": en.to_hex(F.col("data")), "beyond": en.to_hex(F.col("beyond"))}).drop("inner")


# Lists and evolution


@query("SELECT vec_id, embedding[3]::DOUBLE AS third, embedding[-1]::DOUBLE AS last, len(embedding)::INTEGER AS size, 0 AS absent_size FROM embeddings")
def list_get_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", li.get_checked(v, 2).cast("double").alias("third"), li.get_checked(v, F.size(v) - 1).cast("double").alias("last"), F.size(v).alias("size"), F.size(li.read_list(F.lit(None).cast("array<int>"))).alias("absent_size"))


@query("""
SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS v1_values, list(l_linenumber ORDER BY l_linenumber) AS v2_values, '' AS v2_labels, l_orderkey AS record_id, NULL::VARCHAR AS email FROM lineitem GROUP BY l_orderkey""")
def evolve_v1_over_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of structs read as the scalars it grew from, and the scalars as structs; a renamed and a new field."""
    item = F.struct(F.col("l_linenumber").alias("value"), F.col("l_returnflag").alias("label"))
    new = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("values"))
    v1 = T.StructType([T.StructField("id", T.LongType()), T.StructField("values", T.ArrayType(T.IntegerType()))])
    old = catalog.read_as(new, v1)
    element = T.StructType([T.StructField("value", T.IntegerType()), T.StructField("label", T.StringType(), True, {"default": ""})])
    v3 = T.StructType([T.StructField("recordId", T.LongType()), T.StructField("values", T.ArrayType(element)), T.StructField("email", T.StringType())])
    again = catalog.read_as(old, v3, {"recordId": "id"})
    return old.select(F.col("id").alias("l_orderkey"), F.col("values").alias("v1_values")).join(again, F.col("l_orderkey") == F.col("recordId")).select(
        "l_orderkey", "v1_values", F.col("values.value").alias("v2_values"), F.array_join(F.col("values.label"), "").alias("v2_labels"), F.col("recordId").alias("record_id"), "email")


_UPGRADES = [("int", "struct<value:int>", True), ("boolean", "struct<value:boolean>", False), ("struct<value:int>", "boolean", False), ("int", "string", False), ("string", "struct<value:int>", False), ("string", "struct<value:int,label:string>", True), ("bigint", "int", True),
             ("tinyint", "smallint", False), ("struct<value:int,label:string>", "int", True), ("struct<value:int,label:string>", "string", True), ("struct<value:int>", "bigint", False), ("array<bigint>", "array<int>", True), ("array<int>", "string", False), ("struct<a:int>", "struct<b:int,c:string>", True)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {str(ok).lower()})" for a, b, ok in _UPGRADES) + ") t(stored, wanted, readable)")
def list_upgrades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lists can be read as which, worked out by hand in the SQL."""
    return spark.createDataFrame([(a, b, li.upgrades(a, b)) for a, b, _ in _UPGRADES], "stored string, wanted string, readable boolean")


@query(f"""
SELECT l_orderkey, list((l_linenumber % 5)::INTEGER ORDER BY l_linenumber, l_partkey) AS ordinals, list({_TYPES_SQL}[l_linenumber % 5 + 1] ORDER BY l_linenumber, l_partkey) AS names,
  [-1] || list(l_linenumber ORDER BY l_linenumber, l_partkey)[2:] AS changed, min(l_linenumber) * 10 AS first_inner FROM lineitem GROUP BY l_orderkey""")
def list_enums_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list read as enums, one element set, and a value at a path into nested lists."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x.l_linenumber)
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(items.alias("v"))
    enums = li.as_enums(F.transform("v", lambda x: x % 5), EVENT_TYPES)
    record = F.struct(F.transform("v", lambda x: F.struct(F.array(x, x * 10).alias("sizes"))).alias("parts"))
    return l.select("l_orderkey", F.transform(enums, lambda e: e.ordinal).alias("ordinals"), F.transform(enums, lambda e: e["name"]).alias("names"), li.set_at(F.col("v"), 0, F.lit(-1)).alias("changed"), re_.at_path(record, "parts[0].sizes[1]").alias("first_inner"))


@query("SELECT conv_id, list(turn ORDER BY turn, part) AS flat, count(*)::INTEGER AS size FROM (SELECT conv_id, turn, unnest([0, 1]) AS part FROM conversations) GROUP BY conv_id")
def nested_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.array("turn", "turn"))).alias("lists"))
    return nested.select("conv_id", F.flatten("lists").alias("flat"), F.size(F.flatten("lists")).alias("size"))


@query("""
WITH parts AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2),
  slots AS (SELECT l_orderkey, unnest(range(2 * max(l_linenumber))) AS k FROM lineitem GROUP BY 1)
SELECT slots.l_orderkey, list(l_partkey ORDER BY k) FILTER (l_linenumber IS NOT NULL) AS items, list(l_partkey ORDER BY k) AS slots
FROM slots LEFT JOIN parts ON slots.l_orderkey = parts.l_orderkey AND 2 * l_linenumber - 1 = k GROUP BY slots.l_orderkey""")
def list_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists from all lines, as they follow each other and in every second slot."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    whole = li.build_list(parts, ["l_orderkey"], "l_linenumber", "l_partkey")
    sparse = li.build_sparse_list(parts.withColumn("slot", 2 * F.col("l_linenumber") - 1), ["l_orderkey"], "slot", "l_partkey", 2 * F.max("l_linenumber"), "slots")
    return whole.join(sparse, "l_orderkey")


# Partitions, order, batches


@query("SELECT event_id, (ntile(7) OVER (ORDER BY event_id) - 1)::BIGINT AS part FROM events")
def balanced_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    return od.positions(e, F.col("event_id")).select("event_id", od.balanced_range(F.col("position"), e.count(), 7).alias("part"))


@query("""
SELECT '>' || string_agg(p || ':' || s, ',' ORDER BY p) AS result FROM (SELECT p, sum(q)::BIGINT AS s FROM
  (SELECT ntile(5) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS p, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY p)""")
def ordered_map_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold that depends on its order: partial sums joined in the ranges' order."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    mapped = F.concat(F.first("lw_range").cast("string"), F.lit(":"), F.sum("q").cast("string"))
    return od.ordered_map_reduce(l, order, 5, mapped, F.lit(">"), lambda a, x: F.when(a == ">", F.concat(a, x)).otherwise(F.concat(a, F.lit(","), x)))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS turn FROM events")
def keyed_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return od.per_key_order(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", F.col("ts"), F.col("event_id")).drop("ts")


@query("""
WITH e AS (SELECT event_id, md5(event_type || event_id::VARCHAR) AS result, user_id * 31 + event_id > 12000 AS failed FROM events)
SELECT event_id, result FROM e WHERE event_id < coalesce((SELECT min(event_id) FROM e WHERE failed), 9223372036854775807)""")
def ordered_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    done = od.ordered_batch(e, "event_id", F.md5(F.concat("event_type", F.col("event_id").cast("string"))), F.col("user_id") * 31 + F.col("event_id") > 12000)
    return done.select("event_id", "result")


@query("""
WITH e AS (SELECT event_id, 10 + event_id % 400 AS n FROM events), s AS (SELECT min(event_id) AS stop FROM e WHERE n > 405)
SELECT event_id, ((sum(n) OVER (ORDER BY event_id) - n) // 5000)::BIGINT AS batch FROM e, s WHERE event_id < coalesce(stop, 9223372036854775807)""")
def ordered_batch_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by bytes up to the first row that is too large on its own."""
    e = table(spark, sf_dir, "events").select("event_id", (10 + F.col("event_id") % 400).alias("n"))
    big = od.ordered_batch(e, "event_id", F.col("n"), F.col("n") > 405, F.col("n"), 5000)
    return big.select("event_id", "batch")


@query()
def longest_first_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return od.longest_first(table(spark, sf_dir, "documents"), "lang", "doc_id", "n_chars", 8)


# Flow


_EVENT_FLOW = "sum(CASE WHEN event_id % 3 = 2 THEN 0 ELSE 100 + event_id % 50 END - CASE WHEN event_id % 3 = 2 THEN 90 ELSE 0 END) OVER w"
_USER = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(f"""
SELECT event_id, in_flight, largest, delivered, min_rtt, coalesce(in_flight <= largest OR in_flight < largest + 2000, false) AS ready FROM (
  SELECT event_id, ({_EVENT_FLOW})::BIGINT AS in_flight, (max(CASE WHEN event_id % 3 <> 2 THEN 100 + event_id % 50 END) OVER w)::BIGINT AS largest,
    (sum(CASE WHEN event_id % 3 = 2 THEN 90 ELSE 0 END) OVER w)::BIGINT AS delivered, (min(value) OVER w) AS min_rtt FROM events {_USER})""")
def in_flight_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ack = F.col("event_id") % 3 == 2
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    log = flow.flow_log(e, "user_id", ["ts", "event_id"], F.when(~ack, 100 + F.col("event_id") % 50), F.when(ack, 90), 2000, F.col("value"))
    return log.select("event_id", "in_flight", "largest", "delivered", "min_rtt", F.coalesce("ready", F.lit(False)).alias("ready"))


@query(f"""
SELECT event_id, (sum(n) OVER w)::BIGINT AS written, greatest(0, least(n, 5000 - (sum(n) OVER w - n)))::BIGINT AS taken, sum(n) OVER w >= 5000 AS full
FROM (SELECT *, 10 + event_id % 400 AS n FROM events) {_USER}""".replace(" AS full", ' AS "full"'))
def byte_stream_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return flow.cut_over(e, "user_id", ["ts", "event_id"], 10 + F.col("event_id") % 400, 5000).select("event_id", "written", "taken", "full")


@query("SELECT user_id, count(*)::BIGINT AS sends, sum(10 + event_id % 400)::BIGINT AS bytes, max(10 + event_id % 400)::BIGINT AS largest FROM events GROUP BY user_id")
def stream_flow_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same figures from a stream over the table, run until it has caught up."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    return _drained(spark, flow.stream_totals(stream, "user_id", 10 + F.col("event_id") % 400), "complete")


@query("""
SELECT event_id, user_id, row_number() OVER w AS turn, (sum(10 + event_id % 400) OVER w)::BIGINT AS written FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def stream_keyed_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "user_id", "ts", (10 + F.col("event_id") % 400).alias("bytes"))
    return _drained(spark, stream, "append", flow.keyed_batches)


def _drained(spark: SparkSession, stream: DataFrame, mode: str, stores=None) -> DataFrame:
    """What a stream has put out once all of its input is read, from a table in the shared folder;
    ``stores``, given that folder, makes the function that stores a batch."""
    import uuid

    at = f"{shared_dir(spark)}/loomwork/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    run = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(stores(at) if stores else store).start()
    run.awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])
    return out.drop("batch")


# Frames, packing, canonical records, sources


@query("SELECT o_orderkey, (8 * ((o_orderkey % 600 + 1) // 2 + 1))::BIGINT AS table_bytes FROM orders")
def frame_table_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", fr.table_size(F.col("o_orderkey") % 600 + 1).cast("long").alias("table_bytes"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_segments, (8 * (CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 4 END))::BIGINT AS frame_bytes, -o_orderkey AS key_again, o_totalprice AS price_again, md5(printf('%016x', o_custkey)) AS second_md5, true AS cut_refused FROM orders""")
def frame_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with their sign changed and prices, as words of one or two segments."""
    k, price = F.col("o_orderkey"), en.little_endian(en.double_bits(F.col("o_totalprice")), 8)
    key, second = F.concat(en.little_endian(-k, 8), price), en.little_endian(F.col("o_custkey"), 8)
    segments = F.when(k % 2 == 0, F.array(key, second)).otherwise(F.array(F.concat(key, second)))
    last = lambda b: F.element_at(b, F.lit(-1))
    seen = lambda f, b: F.struct(
        F.size(b).alias("n_segments"), F.octet_length(f).cast("long").alias("frame_bytes"), en.read_little_endian(F.get(b, F.lit(0)), 1, 8).alias("key_again"),
        en.bits_double(en.read_little_endian(F.get(b, F.lit(0)), 9, 8)).alias("price_again"), F.md5(F.lower(F.lpad(F.hex(en.read_little_endian(last(b), F.octet_length(last(b)) - 7, 8)), 16, "0"))).alias("second_md5"),
        fr.parse_frame(F.substr(f, F.lit(1), F.octet_length(f) - 1)).isNull().alias("cut_refused"))
    whole = en.let(fr.encode_frame(segments), lambda f: en.let(fr.parse_frame(f), lambda b: seen(f, b)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(F.array(whole)))


_BYTE_ZERO = " + ".join(f"CASE WHEN (o_orderkey * 257) // {256**k} % 256 = 0 THEN 1 ELSE 0 END" for k in range(7))


@query(f"SELECT o_orderkey, (CASE z WHEN 8 THEN 2 WHEN 0 THEN 10 ELSE 9 - z END)::INTEGER AS packed_bytes, (CASE z WHEN 8 THEN 2 WHEN 0 THEN 10 ELSE 9 - z END)::INTEGER AS measured FROM (SELECT o_orderkey, 1 + {_BYTE_ZERO} AS z FROM orders)")
def packed_word_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = en.little_endian(F.col("o_orderkey") * 257, 8)
    return table(spark, sf_dir, "orders").select("o_orderkey", fr.packed_word_size(F.hex(word)).alias("packed_bytes"), F.octet_length(fr.pack(word)).alias("measured"))


_LINE_WORDS = ["-l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(l_quantity AS BIGINT)"]
_TAGGED = " + ".join(f"CASE WHEN {w} = 0 THEN {zero} ELSE 1 + {' + '.join(f'CASE WHEN ({w} >> {8 * k}) & 255 <> 0 THEN 1 ELSE 0 END' for k in range(8))} END" for w, zero in zip(_LINE_WORDS[1:], ("2", "2", "CASE WHEN l_partkey = 0 THEN 0 ELSE 2 END", "2")))


def _line_words() -> list:
    return [en.little_endian(c, 8) for c in (-F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("long"))]


def _read_line(raw) -> list:
    at = lambda k: en.read_little_endian(raw, 8 * k + 1, 8)
    return [at(0).alias("negated"), at(1).cast("int").alias("l_linenumber"), at(2).alias("l_partkey"), at(3).alias("l_suppkey"), at(4).alias("quantity")]


@query(f"""
SELECT -l_orderkey AS negated, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS quantity, ({_TAGGED} + 2)::INTEGER AS bytes_without_key FROM lineitem""")
def packed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as words with a negative key, packed and unpacked, and read from the words again; and
    the packed size of all words but the key, with three words of zeros at the end."""
    words = _line_words()
    l = table(spark, sf_dir, "lineitem").select(fr.unpack(fr.pack(F.concat(*words))).alias("w"), F.octet_length(fr.pack(F.concat(*words[1:], F.lit(bytes(24))))).alias("bytes_without_key"))
    return l.select(*_read_line(F.col("w")), "bytes_without_key")


@query("SELECT -l_orderkey AS negated, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS quantity, 1::BIGINT AS copies FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem)")
def framed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines written as files of packed frames by the data source, over what an earlier
    write left there, read again and counted."""
    import uuid

    from .sources.frames import FramedSource

    spark.dataSource.register(FramedSource)
    at = f"{shared_dir(spark)}/loomwork/frames-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("l_quantity")).distinct()
    rows = lines.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("seq"), F.array(F.concat(*_line_words())).alias("segments"))
    for mode in ("append", "overwrite"):
        rows.write.format("framed").option("framing", "packed").mode(mode).save(at)
    l = spark.read.format("framed").option("framing", "packed").load(at).select(*_read_line(F.get("segments", F.lit(0))))
    return l.groupBy(*l.columns).agg(F.count("*").alias("copies"))


@query("""
SELECT c_custkey, '(custkey = ' || c_custkey || ', name = "' || c_name || '", tags = [' || c_nationkey || ', 7], home = (segment = "' || c_mktsegment || '\\n(x = 1)", rate = 0.5))' AS literal,
  '{"custkey":"' || c_custkey || '","name":"' || c_name || '","tags":[' || c_nationkey || ',7],"home":{"segment":"' || c_mktsegment || '\\n(x = 1)","rate":0.5}}' AS json, NULL::BIGINT AS twice, NULL::BIGINT AS unknown, c_custkey AS hexed FROM customer""".replace("\\\\", "\\"))
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records as text literals, read from them again and written as JSON; literals that name a
    field twice, or one that is not there, are refused."""
    home = F.struct(F.concat("c_mktsegment", F.lit("\n(x = 1)")).alias("segment"), F.lit(0.5).alias("rate"))
    r = F.struct(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.array("c_nationkey", F.lit(7)).alias("tags"), home.alias("home"))
    c = table(spark, sf_dir, "customer").select("c_custkey", r.alias("r"))
    schema = c.schema["r"].dataType
    key = T.StructType([T.StructField("custkey", T.LongType())])
    other = lambda form: js.from_literal(F.format_string(form, "c_custkey"), key).custkey
    c = c.select("c_custkey", js.literal(F.col("r"), schema).alias("literal"))
    return c.select("c_custkey", "literal", js.encode(js.from_literal(F.col("literal"), schema), schema).alias("json"), other("(custkey = %d, custkey = 2)").alias("twice"), other("(custkey = %d, other = 2)").alias("unknown"), other("( custkey = 0x%x )").alias("hexed"))


@query("""
SELECT o_orderkey, '{"key":"' || -o_orderkey || '","cust":"' || o_custkey || '"}' AS json, -o_orderkey AS key, o_custkey AS cust FROM orders""")
def convert_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 64-bit fields to JSON, to frames again, and to a text literal that is read."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("cust", T.LongType())])
    o = table(spark, sf_dir, "orders").select("o_orderkey", fr.frame_of(F.struct((-F.col("o_orderkey")).alias("key"), F.col("o_custkey").alias("cust")), schema).alias("f"))
    o = o.select("o_orderkey", js.encode(fr.record_of(F.col("f"), schema), schema).alias("json"))
    o = o.withColumn("f", fr.frame_of(js.decode(F.col("json"), schema), schema))
    return o.select("o_orderkey", "json", js.from_literal(js.literal(fr.record_of(F.col("f"), schema), schema), schema).alias("r")).select("o_orderkey", "json", "r.*")


@query("""
SELECT sha256('{' || array_to_string(list_filter([CASE WHEN text <> '' THEN '"text":' || to_json(text)::VARCHAR END, CASE WHEN lang <> '' THEN '"lang":"' || lang || '"' END], lambda x: x IS NOT NULL), ',') || '}') AS digest, count(*)::BIGINT AS copies
FROM documents GROUP BY text, lang""")
def canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.distinct_records(table(spark, sf_dir, "documents"), ["text", "lang"])


@query("""
SELECT event_id, event_id % 3 = 0 AS canonical FROM events""")
def canonical_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in their canonical text, with a default written out, and with fields in another order."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("type", T.StringType()), T.StructField("n", T.IntegerType())])
    forms = ['{"id":"%1$d","type":"%2$s"}', '{"id":"%1$d","type":"%2$s","n":0}', '{"type":"%2$s","id":"%1$d"}']
    text = F.get(F.array(*(F.format_string(f, F.col("event_id") + 1, "event_type") for f in forms)), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", ca.is_canonical(text, schema).alias("canonical"))


@query("SELECT c_custkey, (4 + (strlen(c_name) + 8) // 8 + (strlen(c_mktsegment) + 8) // 8 + 1)::BIGINT AS words FROM customer")
def traversal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long key, integer nation, double balance: 3 data words (160 bits), 2 pointers, 2 texts."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", ca.traversal_words(c, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]).alias("words"))


@query("""SELECT * FROM (VALUES ('c_custkey', 0, 'bigint', true), ('c_name', 1, 'string', true), ('c_nationkey', 2, 'int', true), ('c_acctbal', 3, 'double', true), ('c_mktsegment', 4, 'string', true), ('home', 5, 'struct<nation:int,name:string>', false), ('home.nation', 0, 'int', true), ('home.name', 1, 'string', true)) t(path, ordinal, type, nullable)""")
def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return catalog.fields(c.withColumn("home", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))))


@query("""
SELECT 'event_type' AS "enum", (row_number() OVER (ORDER BY event_type) - 1)::INTEGER AS ordinal, event_type AS name FROM (SELECT DISTINCT event_type FROM events)""")
def schema_enumerants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.enumerants(table(spark, sf_dir, "events"), "event_type", "event_type")


@query("""
WITH n AS (SELECT * FROM (VALUES ('customer', NULL, 6, 3, 3), ('customer.home', 'customer', 2, 1, 1)) t(path, parent, fields, data, pointers)), h AS (SELECT *, md5('f00dfeedf00dfeed' || path) AS h FROM n)
SELECT path, parent, fields, data, pointers, CASE WHEN h[1] < '8' THEN ['8','9','a','b','c','d','e','f'][h[1]::INTEGER + 1] ELSE h[1] END || h[2:16] AS type_id FROM h""")
def schema_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return catalog.nodes(c.withColumn("home", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))), "customer", "f00dfeedf00dfeed")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
