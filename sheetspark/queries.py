"""One query per operator over the test tables, and equivalent SQL for the plain engine that checks them.

Queries are named after what they apply; each goes through the library's own functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, numbers, text
from .operators import cells, convert, fill, layout, rows
from .operators.convert import default_registry, read_value
from .operators.schema import SPARK_TYPES, Field, Schema
from .plans.reader import read_bytes, read_files
from .plans.writer import Workbook, write, string_rows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if there is some."""
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


c = F.col

# --- texts ----------------------------------------------------------------------------------------


@query("q_java_trim", r"select c_custkey, regexp_replace(chr(9)||' '||c_name||' '||chr(10),'^[\x00-\x20]+|[\x00-\x20]+$','','g') as name from customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", text.trim(F.concat(F.lit("\t "), c("c_name"), F.lit(" \n"))).alias("name"))


@query("q_blank_tests", r"select doc_id, text is null or text = '' as empty, text is null or regexp_full_match(text, '\s*') as blank, coalesce(regexp_full_match(source, '[0-9]+'), false) as numeric_source, lang is not distinct from 'en' as english from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.is_empty(c("text")).alias("empty"), text.is_blank(c("text")).alias("blank"), text.is_numeric(c("source")).alias("numeric_source"), text.equals(c("lang"), F.lit("en")).alias("english"))


@query("q_region_matches", "select c_custkey, length(c_mktsegment) >= 4 and lower(substr(c_mktsegment, 1, 4)) = 'buil' as m from customer")
def _(s, d):
    return table(s, d, "customer").select("c_custkey", text.region_matches(c("c_mktsegment"), 0, F.lit("xBuil"), 1, 4, True).alias("m"))


@query("q_boolean_value_of", "select event_id, coalesce(lower(case when event_id % 3 = 0 then 'TRUE' when event_id % 3 = 1 then 'yes' end) = 'true', false) as b from events")
def _(s, d):
    v = F.when(c("event_id") % 3 == 0, "TRUE").when(c("event_id") % 3 == 1, "yes")
    return table(s, d, "events").select("event_id", text.boolean_value(v).alias("b"))


@query("q_byte_length", "select doc_id, cast(strlen(text) as integer) as n from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", text.byte_length(c("text")).alias("n"))


@query("q_xml_escape", "select page_id, replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),chr(39),'&apos;') as x from pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", text.xml_escape(c("html")).alias("x"))


@query("q_column_letters", "select p_partkey, case when i<26 then chr(65+i) when i < 702 then chr(64+i//26)||chr(65+i%26) else chr(65+(i-702)//676)||chr(65+((i-702)//26)%26)||chr(65+(i-702)%26) end as col, i as idx from (select p_partkey, cast(p_partkey * 7 % 16384 as int) as i from part)")
def _(s, d):
    i = (c("p_partkey") * 7 % 16384).cast("int")
    return table(s, d, "part").select("p_partkey", text.column_letters(i).alias("col"), text.column_index(text.column_letters(i)).alias("idx"))


@query("q_cell_reference", "select p_partkey, cast(p_partkey % 1000 as int) as r, cast(p_partkey % 26 as int) as cl from part")
def _(s, d):
    made = F.concat(F.lit("$"), F.lower(text.column_letters(c("p_partkey") % 26)), F.lit("$"), (c("p_partkey") % 1000 + 1).cast("string"))
    place = text.cell_reference(made)
    return table(s, d, "part").select("p_partkey", place["row"].alias("r"), place["col"].alias("cl"))


@query("q_image_sniff", "select page_id, case page_id % 4 when 0 then 'png' when 1 then 'jpeg' when 2 then 'gif' end as kind from pages")
def _(s, d):
    head = F.when(c("page_id") % 4 == 0, "89504E470D0A1A0A").when(c("page_id") % 4 == 1, "FFD8FFE000104A46").when(c("page_id") % 4 == 2, "4749463839610000").otherwise("00")
    return table(s, d, "pages").select("page_id", text.image_type(F.unhex(head)).alias("kind"))


@query("q_format_sniff", "select page_id, case page_id % 3 when 0 then 'xlsx' when 1 then 'xls' else 'csv' end as kind from pages")
def _(s, d):
    head = F.when(c("page_id") % 3 == 0, "504B030414000600").when(c("page_id") % 3 == 1, "D0CF11E0A1B11AE1").otherwise("61622C63")
    return table(s, d, "pages").select("page_id", text.file_format(F.unhex(head)).alias("kind"))


@query("q_placeholders", "select r_regionkey, 'name|.key|list.x' as found from region")
def _(s, d):
    t = F.concat(c("r_name"), F.lit(" {name} \\{no\\} {.key}{list.x}"))
    return table(s, d, "region").select("r_regionkey", F.array_join(text.placeholders(t), "|").alias("found"))


@query("q_unescape", "select n_nationkey, n_name || chr(13) || 'A_x00' as t from nation")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", text.unescape_ooxml(F.concat(c("n_name"), F.lit("_x000D__x0041__x00"))).alias("t"))


@query("q_cell_editor", "select l_orderkey, l_linenumber, trim(l_returnflag) as f, cast(trunc(l_quantity) as bigint) as q from lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.trim(c("l_returnflag")).alias("f"), numbers.truncate(c("l_quantity")).cast("long").alias("q"))


# --- numbers --------------------------------------------------------------------------------------


def _round_sql(mode: str) -> str:
    x = "cast(l_extendedprice as decimal(18,4)) * (case when l_linenumber % 2 = 0 then -1 else 1 end)"
    a = f"abs({x})"
    down = f"cast(floor({a} * 10) as bigint)"
    rest = f"({a} * 10 - floor({a} * 10))"
    n = {
        "DOWN": down, "UP": f"cast(ceil({a} * 10) as bigint)", "HALF_UP": f"{down} + cast({rest} >= 0.5 as bigint)", "HALF_DOWN": f"{down} + cast({rest} > 0.5 as bigint)",
        "HALF_EVEN": f"{down} + cast({rest} > 0.5 or ({rest} = 0.5 and {down} % 2 = 1) as bigint)",
        "CEILING": f"{down} + cast({rest} > 0 and {x} > 0 as bigint)", "FLOOR": f"{down} + cast({rest} > 0 and {x} < 0 as bigint)",
    }[mode]
    return f"select l_orderkey, l_linenumber, cast(({n}) * (case when {x} < 0 then -1 else 1 end) as bigint) as tenths from lineitem"


for _mode in ("UP", "DOWN", "CEILING", "FLOOR", "HALF_UP", "HALF_DOWN", "HALF_EVEN"):
    @query(f"q_round_{_mode.lower()}", _round_sql(_mode))
    def _(s, d, mode=_mode):
        x = c("l_extendedprice").cast("decimal(18,4)") * F.when(c("l_linenumber") % 2 == 0, -1).otherwise(1)
        return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (numbers.round_to(x, 1, mode) * 10).cast("long").alias("tenths"))


@query("q_decimal_pattern", "select l_orderkey,l_linenumber, format('{:,.2f}', cast(round(cast(l_extendedprice as decimal(18,4)),2) as double)) as s from lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.format_decimal(c("l_extendedprice").cast("decimal(18,4)"), "#,##0.00").alias("s"))


@query("q_percent_pattern", "select l_orderkey,l_linenumber, cast(cast(round(l_discount*100) as int) as varchar)||'%' as s from lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.format_decimal(F.round(c("l_discount"), 2), "#%").alias("s"))


@query("q_negative_pattern", "select o_orderkey, case when o_orderkey % 2 = 0 and o_orderkey > 0 then '(' || o_orderkey || ')' else 'USD ' || o_orderkey end as s from orders")
def _(s, d):
    v = F.when(c("o_orderkey") % 2 == 0, -c("o_orderkey")).otherwise(c("o_orderkey"))
    return table(s, d, "orders").select("o_orderkey", numbers.format_decimal(v, "'USD '0;(0)").alias("s"))


@query("q_pattern_parse", "select o_orderkey, cast(o_orderkey as varchar) as v, null::varchar as bad from orders")
def _(s, d):
    t = numbers.format_decimal(c("o_orderkey"), "#,##0.00")
    back = numbers.parse_by_pattern(F.concat(t, F.lit("abc")), "#,##0.00")
    return table(s, d, "orders").select("o_orderkey", numbers.plain_string(back).alias("v"), numbers.plain_string(numbers.parse_by_pattern(F.concat(F.lit(" "), t), "#,##0.00")).alias("bad"))


@query("q_fifteen_digits", "select l_orderkey, l_linenumber, cast(round(l_quantity) as bigint) as q from lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.fifteen_digits((c("l_quantity") * 0.1 + c("l_quantity") * 0.2) / 0.3).cast("long").alias("q"))


@query("q_java_string", "select l_orderkey, l_linenumber, cast(cast(l_quantity as bigint) as varchar) || '.0' as s from lineitem")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.java_string(c("l_quantity")).alias("s"))


@query("q_exact_integer_guard", "select o_orderkey, case when abs(v)>9007199254740991 then 'text' else 'number' end as kind from (select o_orderkey, o_orderkey*10000000000000 as v from orders)")
def _(s, d):
    v = c("o_orderkey").cast("decimal(20,0)") * F.lit(10000000000000).cast("decimal(14,0)")  # a long overflows from key 922,338 on
    return table(s, d, "orders").select("o_orderkey", F.when(numbers.is_exact_integer(v), "number").otherwise("text").alias("kind"))


@query("q_general_extreme", "select o_orderkey, case when o_orderkey * 1000000000 >= 100000000000 then cast(o_orderkey * 1000000000 as varchar) end as s from orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", numbers.general_extreme(c("o_orderkey") * F.lit(1000000000)).alias("s"))


@query("q_saturated_cast", "select o_orderkey, cast(greatest(least((o_orderkey - 500) * 10000000, 2147483647), -2147483648) as integer) as i from orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", numbers.saturated((c("o_orderkey") - 500) * 10000000).alias("i"))


def _wrap_sql(x: str, bits: int) -> str:
    return f"((cast({x} as hugeint) + {1 << (bits - 1)}) % {1 << bits} + {1 << bits}) % {1 << bits} - {1 << (bits - 1)}"


_SQL_TYPES = {"byte": "tinyint", "short": "smallint", "int": "integer", "long": "bigint"}
for _t, _bits in convert.BITS.items():
    @query(f"q_parse_{_t}", f"select o_orderkey, cast({_wrap_sql('trunc(cast(o_totalprice as decimal(18,2)) * 1000)', _bits)} as {_SQL_TYPES[_t]}) as v from orders")
    def _(s, d, bits=_bits):
        return table(s, d, "orders").select("o_orderkey", numbers.parse_wrapped((c("o_totalprice").cast("decimal(18,2)") * 1000).cast("string"), bits).alias("v"))

# --- dates ----------------------------------------------------------------------------------------


@query("q_serial_from_ts", "select o_orderkey, cast(date_diff('day', date '1899-12-30', cast(o_orderdate as date)) as double) as serial from orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", dates.to_serial(c("o_orderdate").cast("date")).alias("serial"))


@query("q_ts_from_serial", "select l_orderkey,l_linenumber, strftime(case when p<61 then date '1899-12-31' else date '1899-12-30' end + p, '%Y-%m-%d') as d from (select l_orderkey,l_linenumber,cast(l_quantity as int)+35 as p from lineitem)")
def _(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", dates.format_datetime(dates.from_serial(c("l_quantity").cast("int") + 35), "yyyy-MM-dd").alias("d"))


@query("q_serial_1904", "select o_orderkey, strftime(date '1904-01-01' + cast(o_orderkey % 40000 as int), '%Y-%m-%d') || ' 12:00:00' as t from orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", dates.format_datetime(dates.from_serial(c("o_orderkey") % 40000 + 0.5, True)).alias("t"))


@query("q_serial_round_trip", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as t from events")
def _(s, d):
    whole = F.date_trunc("second", c("ts"))
    return table(s, d, "events").select("event_id", dates.format_datetime(dates.from_serial(dates.to_serial(whole))).alias("t"))


@query("q_date_patterns", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d from orders")
def _(s, d):
    t = F.when(c("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return table(s, d, "orders").select("o_orderkey", dates.format_datetime(dates.parse_date(t), "yyyy-MM-dd").alias("d"))


@query("q_datetime_patterns", "select event_id, strftime(ts, '%Y-%m-%d %H:%M') as t from events")
def _(s, d):
    p = ["yyyyMMddHHmmss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyyMMdd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss"]
    made = F.element_at(F.array(*[F.date_format("ts", x) for x in p]), (c("event_id") % 6 + 1).cast("int"))
    return table(s, d, "events").select("event_id", dates.format_datetime(dates.parse_datetime(made), "yyyy-MM-dd HH:mm").alias("t"))


@query("q_date_format", "select event_id, strftime(ts, '%d.%m.%Y %H-%M') as t from events")
def _(s, d):
    return table(s, d, "events").select("event_id", dates.format_datetime(c("ts"), "%d.%m.%Y %H-%M").alias("t"))


@query("q_is_date_format", "select n_nationkey, n_nationkey % 3 = 0 or n_nationkey between 14 and 22 as y from nation")
def _(s, d):
    code = F.when(c("n_nationkey") % 3 == 0, "yyyy-mm-dd").when(c("n_nationkey") % 3 == 1, '#,##0.00 "days"').otherwise("[Red]0")
    return table(s, d, "nation").select("n_nationkey", dates.is_date_format(code, c("n_nationkey")).alias("y"))


@query("q_java_date", "select n_nationkey, strftime(date '1899-12-30' + n_nationkey * 1000, '%Y-%m-%d') as d from nation")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", F.date_format(dates.java_date(c("n_nationkey") * 1000), "yyyy-MM-dd").alias("d"))


# --- converters -----------------------------------------------------------------------------------

_REG = default_registry()
_PRICE = "cast(o_totalprice as decimal(18,2)) * (case when o_orderkey % 2 = 0 then -1 else 1 end)"


def _price():
    return c("o_totalprice").cast("decimal(18,2)") * F.when(c("o_orderkey") % 2 == 0, -1).otherwise(1)


def _converted(s, d, made, t: str, fmt: str | None = None) -> DataFrame:
    """A cell of orders read as a type."""
    v = read_value(c("cell"), Field("v", t, format=fmt), _REG)
    if t in ("decimal", "bigint"):
        v = (v * 100).cast("long")  # hundredths
    return table(s, d, "orders").select("o_orderkey", made.alias("cell")).select("o_orderkey", v.alias("v"))


def _number_sql(t: str) -> str:
    if t in convert.BITS:
        return f"cast({_wrap_sql(f'trunc({_PRICE})', convert.BITS[t])} as {_SQL_TYPES[t]})"
    return {"decimal": f"cast({_PRICE} * 100 as bigint)", "bigint": f"cast(trunc({_PRICE}) * 100 as bigint)", "float": "cast(cast(o_orderkey as double) / 4 as float)", "double": "cast(o_orderkey as double) / 4"}[t]


for _t in ("decimal", "bigint", "byte", "short", "int", "long", "float", "double"):
    _sql_t = {"decimal": "bigint", "bigint": "bigint", "float": "float", "double": "double"}.get(_t) or _SQL_TYPES[_t]
    _one = 100 if _t in ("decimal", "bigint") else 1

    @query(f"q_cnv_{_t}_boolean", f"select o_orderkey, cast(case when o_orderkey % 3 = 0 then {_one} else 0 end as {_sql_t}) as v from orders")
    def _(s, d, t=_t):
        return _converted(s, d, cells.cell("B", b=c("o_orderkey") % 3 == 0), t)

    @query(f"q_cnv_{_t}_number", f"select o_orderkey, {_number_sql(_t)} as v from orders")
    def _(s, d, t=_t):
        n = (c("o_orderkey") / 4) if t in ("float", "double") else _price()
        return _converted(s, d, cells.cell("N", n=n), t)

    @query(f"q_cnv_{_t}_string", f"select o_orderkey, {_number_sql(_t)} as v from orders")
    def _(s, d, t=_t):
        n = (c("o_orderkey") / 4) if t in ("float", "double") else _price()
        return _converted(s, d, cells.cell("S", s=n.cast("string")), t)

    # the whole table: bytes and shorts wrapped, signs of both kinds
    _signed = "o_orderkey * (case when o_orderkey % 2 = 0 then -1 else 1 end)"
    _all = _wrap_sql(_signed, convert.BITS[_t]) if _t in ("byte", "short") else _signed

    @query(f"q_cnv_{_t}_write_all", f"select o_orderkey, cast(v as varchar){chr(32) + '|| ' + repr('.0') if _t in ('float', 'double') else ''} as plain, format('{{:,.2f}}', cast(v as double)) as formatted, v = 1 as flag from (select o_orderkey, cast({_all} as bigint) as v from orders)")
    def _(s, d, t=_t):
        n = c("o_orderkey") * F.when(c("o_orderkey") % 2 == 0, -1).otherwise(1)
        v = (numbers.wrap(n, convert.BITS[t]) if t in ("byte", "short") else n).cast(SPARK_TYPES[t])
        w = lambda target, f=None: convert.write_value(v, Field("v", t, format=f), _REG, target)
        return table(s, d, "orders").select("o_orderkey", w("string").alias("plain"), w("string", "#,##0.00").alias("formatted"), w("boolean")["b"].alias("flag"))


@query("q_cnv_double_extreme", "select o_orderkey, o_orderkey * 1e25 as large, o_orderkey * 1e-20 as tiny, o_orderkey * 1e295 as huge, o_orderkey * 1e25 as by_text from orders")
def _(s, d):
    k = c("o_orderkey").cast("double")
    made = {"large": cells.cell("N", n=k * 1e25), "tiny": cells.cell("N", n=k * 1e-20), "huge": cells.cell("N", n=k * 1e295), "by_text": cells.cell("S", s=(k * 1e25).cast("string"))}
    df = table(s, d, "orders").select("o_orderkey", *[cell.alias(name) for name, cell in made.items()])
    return df.select("o_orderkey", *[read_value(c(name), Field(name, "double"), _REG).alias(name) for name in made])


@query("q_xlsx_extreme_numbers", "select n_nationkey, cast((n_nationkey + 1) || 'e25' as double) as large, cast((n_nationkey + 1) || 'e-20' as double) as tiny, cast((n_nationkey + 1) || 'e300' as double) as huge from nation")
def _(s, d):
    schema = Schema([Field("n_nationkey", "long"), Field("large", "double"), Field("tiny", "double"), Field("huge", "double")])
    k = c("n_nationkey").cast("double") + 1
    made = write(table(s, d, "nation").select("n_nationkey", (k * 1e25).alias("large"), (k * 1e-20).alias("tiny"), (k * 1e300).alias("huge")), ["n_nationkey"], schema).to_xlsx()
    digits = lambda name: numbers.fifteen_digits(c(name)).alias(name)
    return read_bytes(s, made).schema(schema).load().select("n_nationkey", digits("large"), digits("tiny"), digits("huge"))


@query("q_cnv_number_pattern", "select o_orderkey, o_orderkey as v from orders")
def _(s, d):
    return _converted(s, d, cells.cell("S", s=F.concat(c("o_orderkey").cast("string"), F.lit("%"))), "decimal", "#%")



@query("q_cnv_boolean_boolean", "select o_orderkey, o_orderkey % 2 = 0 as v from orders")
def _(s, d):
    return _converted(s, d, cells.cell("B", b=c("o_orderkey") % 2 == 0), "boolean")


@query("q_cnv_boolean_number", "select l_orderkey,l_linenumber,(l_linenumber=1) as b, cast(case when l_linenumber = 1 then 1 else 0 end as bigint) as n from lineitem")
def _(s, d):
    df = table(s, d, "lineitem").withColumn("cell", cells.cell("N", n=c("l_linenumber")))
    b = read_value(c("cell"), Field("b", "boolean"), _REG)
    return df.select("l_orderkey", "l_linenumber", b.alias("b"), convert.write_value(b, Field("b", "boolean"), _REG, "number")["n"].cast("long").alias("n"))


@query("q_cnv_boolean_string", "select event_id, event_id % 3 = 0 as v from events")
def _(s, d):
    t = F.when(c("event_id") % 3 == 0, "True").when(c("event_id") % 3 == 1, "1").otherwise("x")
    return table(s, d, "events").select("event_id", cells.cell("S", s=t).alias("cell")).select("event_id", read_value(c("cell"), Field("v", "boolean"), _REG).alias("v"))


for _t, _cast in (("date", "date"), ("datetime", "timestamp")):
    @query(f"q_cnv_{_t}_number", f"select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as v, cast(date_diff('day', date '1899-12-30', cast(o_orderdate as date)) as bigint) as n from orders")
    def _(s, d, t=_t):
        df = table(s, d, "orders").withColumn("cell", cells.cell("N", n=dates.to_serial(c("o_orderdate").cast("date"))))
        v = read_value(c("cell"), Field("v", t), _REG)
        return df.select("o_orderkey", F.date_format(v, "yyyy-MM-dd").alias("v"), convert.write_value(v, Field("v", t), _REG, "number")["n"].cast("long").alias("n"))

    @query(f"q_cnv_{_t}_string", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as v, strftime(o_orderdate, '%d/%m/%Y') as w from orders")
    def _(s, d, t=_t):
        made = F.date_format("o_orderdate", "yyyy-MM-dd" if t == "date" else "yyyy/MM/dd HH:mm:ss")
        df = table(s, d, "orders").withColumn("cell", cells.cell("S", s=made))
        v = read_value(c("cell"), Field("v", t), _REG)
        return df.select("o_orderkey", F.date_format(v, "yyyy-MM-dd").alias("v"), convert.write_value(v, Field("v", t, format="dd/MM/yyyy"), _REG, "string").alias("w"))

    @query(f"q_cnv_{_t}_date", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as v from orders")
    def _(s, d, t=_t):
        df = table(s, d, "orders").withColumn("cell", convert.write_value(c("o_orderdate").cast(SPARK_TYPES[t]), Field("v", t), _REG))
        return df.select("o_orderkey", F.date_format(read_value(c("cell"), Field("v", t), _REG), "yyyy-MM-dd").alias("v"))


@query("q_cnv_string_boolean", "select o_orderkey, case when o_orderkey % 2 = 0 then 'true' else 'false' end as v, o_orderkey % 2 = 0 as b from orders")
def _(s, d):
    df = table(s, d, "orders").withColumn("cell", cells.cell("B", b=c("o_orderkey") % 2 == 0))
    v = read_value(c("cell"), Field("v"), _REG)
    return df.select("o_orderkey", v.alias("v"), convert.write_value(v, Field("v"), _REG, "boolean")["b"].alias("b"))


@query("q_cnv_string_number", "select o_orderkey, cast(o_orderkey as varchar) as plain, format('{:,.1f}', cast(o_orderkey as double)) as formatted, 'shown' as shown, strftime((case when o_orderkey < 61 then date '1899-12-31' else date '1899-12-30' end) + cast(o_orderkey as int), '%Y-%m') as month from orders")
def _(s, d):
    df = table(s, d, "orders").select("o_orderkey", cells.cell("N", n=c("o_orderkey")).alias("a"), cells.cell("N", n=c("o_orderkey"), display=F.lit("shown")).alias("b"))
    v = lambda col, f=None: read_value(c(col), Field("v", format=f), _REG)
    return df.select("o_orderkey", v("a").alias("plain"), v("a", "#,##0.0").alias("formatted"), v("b").alias("shown"), v("a", "yyyy-MM").alias("month"))


@query("q_cnv_string_string", "select o_orderkey, o_orderpriority as v from orders")
def _(s, d):
    return _converted(s, d, cells.cell("S", s=c("o_orderpriority")), "string")


@query("q_cnv_string_error", "select o_orderkey, '#DIV/0!' as v from orders")
def _(s, d):
    return _converted(s, d, cells.cell("E", s=F.lit("#DIV/0!")), "string")


@query("q_loose_boolean", "select event_id, case event_id % 5 when 0 then true when 1 then false when 2 then true when 3 then false end as b from events")
def _(s, d):
    k = c("event_id") % 5
    cell = F.when(k == 0, cells.cell("N", n=F.lit(7))).when(k == 1, cells.cell("N", n=F.lit(0))).when(k == 2, cells.cell("S", s=F.lit("1"))).when(k == 3, cells.cell("S", s=F.lit("False"))).otherwise(cells.cell("S", s=F.lit("x")))
    return table(s, d, "events").select("event_id", cell.alias("cell")).select("event_id", convert.loose_boolean(c("cell")).alias("b"))


@query("q_strict_unsigned", "select o_orderkey, case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then null else cast(o_orderkey % 200 as smallint) end as v from orders")
def _(s, d):
    k, n = c("o_orderkey") % 4, c("o_orderkey") % 200
    cell = F.when(k == 0, cells.cell("N", n=n + 0.5)).when(k == 1, cells.cell("N", n=-n - 1)).when(k == 2, cells.cell("N", n=n)).otherwise(cells.cell("S", s=n.cast("string")))
    return _converted(s, d, cell, "ubyte")


@query("q_field_converter", "select n_nationkey, upper(n_name) || '!' as v from nation")
def _(s, d):
    df = table(s, d, "nation").select("n_nationkey", cells.cell("S", s=c("n_name")).alias("cell"))
    f = Field("v", converter=lambda cell, ctx: F.concat(F.upper(cell["s"]), F.lit("!")))
    return df.select("n_nationkey", read_value(c("cell"), f, _REG).alias("v"))


@query("q_user_registry", "select n_nationkey, n_name || '?' as v from nation")
def _(s, d):
    mine = _REG.copy().register_reader("string", "S", lambda cell, ctx: F.concat(cell["s"], F.lit("?")))
    return table(s, d, "nation").select("n_nationkey", cells.cell("S", s=c("n_name")).alias("cell")).select("n_nationkey", read_value(c("cell"), Field("v"), mine).alias("v"))


@query("q_option_null", "select event_id, case when event_id % 2 = 0 then cast(event_id as integer) end as v, case when event_id % 2 = 0 then cast(event_id as varchar) else '' end as t from events")
def _(s, d):
    cell = F.when(c("event_id") % 2 == 0, cells.cell("S", s=c("event_id").cast("string")))
    df = table(s, d, "events").select("event_id", cell.alias("a"), cell.alias("b"))
    return convert.bind(df, [("a", Field("v", "int")), ("b", Field("t", nullable=False))], mode=convert.PERMISSIVE, keep=("event_id",)).drop("_error")


def _bad_events(s, d):
    t = F.when(c("event_id") % 10 == 0, "x").otherwise(F.get_json_object("props", "$.k"))
    return table(s, d, "events").select("event_id", cells.cell("S", s=t).alias("a"))


@query("q_skip_bad_rows", "select event_id, try_cast(k as int) as k from (select event_id, case when event_id%10=0 then 'x' else json_extract_string(props,'$.k') end as k from events) where k is null or try_cast(k as int) is not null")
def _(s, d):
    return convert.bind(_bad_events(s, d), [("a", Field("k", "int"))], mode=convert.DROP, keep=("event_id",))


@query("q_error_column", "select event_id, 'k' as field, 'x' as value, 'not a int' as message from events where event_id % 10 = 0")
def _(s, d):
    bound = convert.bind(_bad_events(s, d), [("a", Field("k", "int"))], mode=convert.PERMISSIVE, keep=("event_id",))
    return bound.where("_error is not null").select("event_id", "_error.field", "_error.value", "_error.message")


@query("q_cell_text", "select event_id, strftime(ts,'%Y-%m-%d %H:%M:%S') as ts_text, strftime(ts, '%Y-%m-%d') as d_text, case when event_id % 2 = 0 then 'true' else 'false' end as b_text, '' as i_text from events")
def _(s, d):
    return table(s, d, "events").select(
        "event_id", cells.text(c("ts"), "datetime").alias("ts_text"), cells.text(c("ts").cast("date"), "date").alias("d_text"),
        cells.text(c("event_id") % 2 == 0, "boolean").alias("b_text"), cells.text(F.lit(None).cast("binary"), "binary").alias("i_text"),
    )


@query("q_default_return", "select o_orderkey, cast(o_orderkey as varchar) as shown, 'N' as kind, cast(o_orderkey as double) as actual from orders")
def _(s, d):
    df = table(s, d, "orders").select("o_orderkey", cells.cell("N", n=c("o_orderkey")).alias("a"))
    return df.select("o_orderkey", cells.display(c("a")).alias("shown"), c("a")["kind"].alias("kind"), F.variant_get(cells.actual(c("a")), "$.v", "double").alias("actual"))


# --- rows -----------------------------------------------------------------------------------------


@query("q_row_range", "select n_nationkey,n_name from nation where n_nationkey+1 between 3 and 9")
def _(s, d):
    return rows.row_range(table(s, d, "nation").withColumn("_row", c("n_nationkey") + 1), 3, 9).select("n_nationkey", "n_name")


@query("q_skip_head", "select n_nationkey, n_name from nation where n_nationkey >= 2")
def _(s, d):
    return rows.skip_head(table(s, d, "nation").withColumn("_row", c("n_nationkey")), 2).drop("_row", "n_regionkey")


@query("q_ignore_empty_row", r"select doc_id, line from (select doc_id, regexp_replace(line,'^[\x00-\x20]+|[\x00-\x20]+$','','g') as line from (select doc_id, unnest(string_split(text,chr(10))) as line from documents)) where line<>''")
def _(s, d):
    lines = table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    kept = rows.ignore_empty(lines.select("doc_id", F.array("line").alias("values")))
    return kept.select("doc_id", rows.trimmed(c("values"))[0].alias("line"))


@query("q_missing_rows", "select cast(i as bigint) as _row, n_name from (select unnest(range(0, 27)) as i) left join (select * from nation where n_nationkey % 3 = 0) on n_nationkey = i")
def _(s, d):
    have = table(s, d, "nation").where("n_nationkey % 3 = 0").select(c("n_nationkey").cast("long").alias("_row"), "n_name")
    return rows.with_missing_rows(have, 26)


@query("q_header_resolution", "select 'name' as label, 2 as i union all select 'key', 1")
def _(s, d):
    found = rows.head_labels([" name ", "key", "name", "", None])
    return s.createDataFrame([(k, v) for k, v in found.items()], "label string, i int")


@query("q_dynamic_row_map", "select n_nationkey, 0 as col, n_name as v from nation union all select n_nationkey, 1, cast(n_regionkey as varchar) from nation")
def _(s, d):
    made = rows.dynamic_map(F.array("n_name", c("n_regionkey").cast("string")))
    return table(s, d, "nation").select("n_nationkey", F.explode(made).alias("col", "v"))


@query("q_dense_cells", "select n_nationkey, n_name || '|?|' || n_regionkey as cells from nation")
def _(s, d):
    m = F.create_map(F.lit(0), c("n_name"), F.lit(2), c("n_regionkey").cast("string"))
    return table(s, d, "nation").select("n_nationkey", F.array_join(rows.dense(m), "|", "?").alias("cells"))


@query("q_jagged_rows", "select n_nationkey, cast(3 as integer) as n, n_name as first, case when n_nationkey % 2 = 0 then cast(n_regionkey as varchar) end as second from nation where n_nationkey % 5 > 0 union all select n_nationkey, 4, n_name, cast(n_regionkey as varchar) from nation where n_nationkey % 5 = 0")
def _(s, d):
    key, reg = c("n_nationkey"), c("n_regionkey").cast("string")
    values = F.when(key % 5 == 0, F.array("n_name", reg, reg, reg)).when(key % 2 == 0, F.array("n_name", reg)).otherwise(F.array("n_name"))
    fit = rows.fit_width(values, 3)
    return table(s, d, "nation").select(key, F.size(fit).alias("n"), *[p.alias(n) for p, n in zip(rows.pick(fit, [0, 1]), ("first", "second"))])


@query("q_absent_rows", "select n_nationkey as _row, n_name from nation where n_nationkey % 4 > 0")
def _(s, d):
    df = table(s, d, "nation").select(c("n_nationkey").alias("_pos"), F.when(c("n_nationkey") % 4 > 0, F.struct("n_name")).alias("row"))
    return rows.present(df).select("_row", "row.n_name")


@query("q_multi_sheet_union", "select 0 as sheet_no, r_name as name from region union all select 1, n_name from nation")
def _(s, d):
    r, n = table(s, d, "region").select(c("r_name").alias("name")), table(s, d, "nation").select(c("n_name").alias("name"))
    return rows.union_sheets([(0, "r", r), (1, "n", n)]).select("sheet_no", "name")


@query("q_sheet_selection", "select unnest([1, 2]) as sheet_no")
def _(s, d):
    return s.createDataFrame([(i,) for i in rows.select_sheets(["a ", "b", "c"], [" b", 2, "zz"])], "sheet_no int")


_PLANNED = Schema([Field("p_name", order=2), Field("p_brand", index=0), Field("p_size", "int", order=1), Field("p_type", ignore=True), Field("p_retailprice", "double", index=4)])


@query("q_ordered_columns", "select p_partkey, p_brand as c0, cast(p_size as varchar) as c1, p_name as c2, '' as c3, cast(cast(floor(p_retailprice) as bigint) as varchar) || '.0' as c4 from part")
def _(s, d):
    df = table(s, d, "part").withColumn("p_retailprice", F.floor("p_retailprice").cast("double"))
    keyed = string_rows(df, [*_PLANNED.columns(), (5, Field("p_partkey", "long"))])
    return keyed.select(c("values")[5].cast("long").alias("p_partkey"), *[c("values")[i].alias(f"c{i}") for i in range(5)])


def _selected(name: str, sql: str, **how):
    @query(name, sql)
    def _(s, d):
        columns = [*_PLANNED.selected(**how), (9, Field("p_partkey", "long"))]
        made = string_rows(table(s, d, "part").withColumn("p_retailprice", F.lit(0.0)), columns)
        width = max(i for i, _ in columns[:-1]) + 1
        return made.select(c("values")[9].cast("long").alias("p_partkey"), *[c("values")[i].alias(f"c{i}") for i in range(width)])


_selected("q_include_columns", "select p_partkey, '' as c0, '' as c1, p_name as c2 from part", include_names=["p_name"])
_selected("q_include_index_or_name", "select p_partkey, p_brand as c0, '' as c1, p_name as c2 from part", include_names=["p_name"], include_indexes=[0])
_selected("q_exclude_columns", "select p_partkey, '' as c0, cast(p_size as varchar) as c1, p_name as c2 from part", exclude_names=("p_brand",), exclude_indexes=(4,))
_selected("q_include_order", "select p_partkey, p_name as c0, p_brand as c1 from part", include_names=["p_name", "p_brand"], by_include_order=True)

# --- positions ------------------------------------------------------------------------------------


@query("q_width_agg", "select least(255,greatest(octet_length(encode('name')),max(strlen(c_name)))) as w0, least(255,greatest(7,max(strlen(c_mktsegment)))) as w1 from customer")
def _(s, d):
    return layout.longest_widths(table(s, d, "customer"), {"w0": ("name", c("c_name")), "w1": ("segment", c("c_mktsegment"))})


@query("q_row_count", "select count(*) as n from customer")
def _(s, d):
    schema = Schema([Field("c_custkey", "long"), Field("c_name")])
    made = write(table(s, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], schema).to_csv()
    return read_bytes(s, made).schema(schema).load().agg(F.count("*").alias("n"))


@query("q_page_batches", "select cast(floor((rn-1)/100) as bigint) as batch_index, count(*) as n from (select row_number() over(order by o_orderkey) rn from orders) group by 1")
def _(s, d):
    placed = layout.numbered(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return placed.groupBy(layout.page_batches(c("_at"), 100).alias("batch_index")).agg(F.count("*").alias("n"))


@query("q_loop_merge", "select cast(rn as bigint) as first_row, cast(rn+1 as bigint) as last_row, 0::bigint as first_col, 1::bigint as last_col from (select row_number() over(order by n_nationkey) rn from nation) where (rn-1)%2=0 union all select rn, rn + 4, 3, 3 from (select row_number() over(order by n_nationkey) rn from nation) where (rn-1)%5=0")
def _(s, d):
    placed = layout.numbered(table(s, d, "nation"), ["n_nationkey"])
    return layout.loop_merges(placed, [(2, 0, 2), (5, 3, 1), (2, 0, 2)], 1)


@query("q_style_cycle", "select n_nationkey, cast((row_number() over(order by n_nationkey)-1)%3 as bigint) as style from nation")
def _(s, d):
    return layout.numbered(table(s, d, "nation"), ["n_nationkey"]).select("n_nationkey", layout.style_cycle(c("_at"), 3).alias("style"))


@query("q_head_merge_runs", "select grp, min(i) as c0, max(i) as c1, min(lbl) as lbl from (select i,lbl,cast(sum(chg) over(order by i) as bigint) as grp from (select i,lbl,case when lag(lbl) over(order by i)=lbl then 0 else 1 end as chg from (select n_nationkey i, cast(n_regionkey as varchar) lbl from nation))) group by grp")
def _(s, d):
    return layout.equal_runs(table(s, d, "nation").withColumn("lbl", c("n_regionkey").cast("string")), "n_nationkey", "lbl")


@query("q_running_position", "select n_nationkey, cast(row_number() over (order by n_regionkey, n_nationkey) + 2 as bigint) as _row from nation")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", layout.running_position("n_regionkey", "n_nationkey", 3).alias("_row"))


@query("q_collection_cursor", "select n_nationkey, cast(row_number() over (partition by n_regionkey order by n_nationkey) + 9 as bigint) as _row from nation")
def _(s, d):
    return table(s, d, "nation").select("n_nationkey", layout.collection_cursor("n_regionkey", ["n_nationkey"], F.lit(10)).alias("_row"))


@query("q_sheet_order", "select cast(row_number() over (order by r_regionkey desc) - 1 as integer) as sheet_no, r_name as sheet_name from region")
def _(s, d):
    region, book = table(s, d, "region"), Workbook()
    for r in region.orderBy(F.desc("r_regionkey")).collect():
        book.write(write(region.where(c("r_regionkey") == r["r_regionkey"]), ["r_regionkey"], sheet=r["r_name"]))
    return read_bytes(s, book.finish()).sheets().drop("file")


@query("q_limit_has_next", "select n_nationkey from nation order by n_nationkey limit 7")
def _(s, d):
    made = write(table(s, d, "nation"), ["n_nationkey"], _NATION).to_csv()
    return read_bytes(s, made).rows(end=7).schema(_NATION).load().select(c("n_nationkey").cast("long"))


@query("q_append_union", "select 0 as sheet_no, n_name as name, n_regionkey as k from nation union all select 1, r_name, null from region")
def _(s, d):
    nation = table(s, d, "nation").select(c("n_name").alias("name"), c("n_regionkey").alias("k"))
    return rows.union_sheets([(0, "a", nation), (1, "b", table(s, d, "region").select(c("r_name").alias("name")))]).drop("sheet_name")


@query("q_distinct_merges", "select n_nationkey + 3 as first_row, n_nationkey + 4 as last_row, 1::bigint as first_col, 1::bigint as last_col from nation where n_nationkey % 2 = 0")
def _(s, d):
    return layout.loop_merges(layout.numbered(table(s, d, "nation"), ["n_nationkey"]), [(2, 1, 1), (2, 1, 1), (2, 1, 1)], 3)


# --- templates ------------------------------------------------------------------------------------


@query("q_fill_scalar", "select r_regionkey, r_name || ' has key ' || r_regionkey || ' {other} {x}' as v from region")
def _(s, d):
    t = F.lit("{name} has key {key} {other} \\{x\\}")
    return table(s, d, "region").select("r_regionkey", text.fill_placeholders(t, {"name": c("r_name"), "key": c("r_regionkey")}).alias("v"))


def _template(s):
    return s.createDataFrame([(5, 0, "{.n_name}"), (5, 1, "{.n_regionkey}"), (5, 2, "{r.n_name}"), (1, 0, "{title}")], "row long, col long, text string")


@query("q_fill_list_vertical", "select 5+rn-1 as row, c as col, case c when 0 then n_name else cast(n_regionkey as varchar) end as text from (select *, row_number() over(order by n_nationkey) rn from nation) cross join (select unnest([0,1]) c)")
def _(s, d):
    return fill.fill_list(_template(s), table(s, d, "nation"), ["n_nationkey"])


@query("q_fill_horizontal", "select cast(5 as bigint) as row, c + rn - 1 as col, case c when 0 then n_name else cast(n_regionkey as varchar) end as text from (select *, row_number() over(order by n_nationkey) rn from nation) cross join (select unnest([0,1]) c)")
def _(s, d):
    return fill.fill_list(_template(s), table(s, d, "nation"), ["n_nationkey"], horizontal=True)


@query("q_named_list_fill", "select 5 + rn - 1 as row, cast(2 as bigint) as col, n_name as text from (select *, row_number() over(order by n_nationkey) rn from nation)")
def _(s, d):
    return fill.fill_list(_template(s), table(s, d, "nation"), ["n_nationkey"], prefix="r")


@query("q_force_new_row_shift", "select n_nationkey, n_nationkey + case when n_nationkey>4 then (select count(*) from region)-1 else 0 end as row from nation")
def _(s, d):
    return fill.shift_rows(table(s, d, "nation").select("n_nationkey", c("n_nationkey").cast("long").alias("row")), 4, table(s, d, "region").count())


@query("q_fill_append", "select row, col, text from (values (1, 0, 'Report')) t(row, col, text) union all select 2 + n_nationkey, 0, n_name from nation")
def _(s, d):
    head = fill.fill_scalars(_template(s).where("row = 1"), {"title": "Report"})
    return fill.append_rows(head, table(s, d, "nation").select("n_nationkey", F.array("n_name").alias("values")), ["n_nationkey"])


# --- files ----------------------------------------------------------------------------------------

_NATION = Schema([Field("n_nationkey", "int", ("Key",)), Field("n_name", "string", ("Name",)), Field("n_regionkey", "int", ("Region",))])
_ORDERS = Schema([Field("o_orderkey", "long"), Field("o_orderstatus"), Field("o_totalprice", "double"), Field("o_orderdate", "datetime")])
_ORDERS_SQL = "select o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate from orders"


def _orders(s, d) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", c("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@query("q_csv_round_trip", "select n_nationkey, n_name, n_regionkey from nation")
def _(s, d):
    made = write(table(s, d, "nation"), ["n_nationkey"], _NATION).to_csv()
    return read_bytes(s, made).schema(_NATION).load()


@query("q_csv_orders", _ORDERS_SQL)
def _(s, d):
    made = write(_orders(s, d), ["o_orderkey"], _ORDERS).files("csv")
    return read_files(made).schema(_ORDERS).load().withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query("q_csv_gbk", "select n_nationkey, '国' || n_name as n_name, n_regionkey from nation")
def _(s, d):
    df = table(s, d, "nation").withColumn("n_name", F.concat(F.lit("国"), "n_name"))
    made = write(df, ["n_nationkey"], _NATION).to_csv("gbk", False)
    return read_bytes(s, made).option(charset="GBK").schema(_NATION).load()


@query("q_csv_utf16", "select n_nationkey, 'é,\"' || n_name as n_name, n_regionkey from nation")
def _(s, d):
    df = table(s, d, "nation").withColumn("n_name", F.concat(F.lit('é,"'), "n_name"))
    return read_bytes(s, write(df, ["n_nationkey"], _NATION).to_csv("utf-16-le")).schema(_NATION).load()


@query("q_xlsx_round_trip", _ORDERS_SQL)
def _(s, d):
    made = write(_orders(s, d), ["o_orderkey"], _ORDERS).files("xlsx")
    return read_files(made).schema(_ORDERS).load().withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query("q_xls_round_trip", _ORDERS_SQL)
def _(s, d):
    made = write(_orders(s, d), ["o_orderkey"], _ORDERS).files("xls")
    return read_files(made).schema(_ORDERS).load().withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def _book(s, d) -> bytes:
    book = Workbook()
    nation = table(s, d, "nation")
    book.write(write(nation.where("n_nationkey < 10"), ["n_nationkey"], _NATION, sheet="nations"))
    book.write(write(table(s, d, "region"), ["r_regionkey"], sheet="regions"))
    book.write(write(nation.where("n_nationkey >= 10"), ["n_nationkey"], _NATION, sheet="nations"))
    return book.finish()


@query("q_xlsx_multi_write", "select n_nationkey, n_name, n_regionkey from nation")
def _(s, d):
    return read_bytes(s, _book(s, d)).sheet("nations").schema(_NATION).load()


@query("q_xlsx_sheets", "select 0 as sheet_no, 'nations' as sheet_name union all select 1, 'regions'")
def _(s, d):
    return read_bytes(s, _book(s, d)).sheets().drop("file")


@query("q_xlsx_no_model", "select r_regionkey + 1 as _row, 0 as col, cast(r_regionkey as varchar) as v from region union all select r_regionkey + 1, 1, r_name from region")
def _(s, d):
    read = read_bytes(s, _book(s, d)).sheet(1).dynamic()
    return read.select("_row", F.explode("values").alias("col", "v"))


@query("q_header_alias", "select n_nationkey as key, n_name as title from nation")
def _(s, d):
    made = write(table(s, d, "nation"), ["n_nationkey"], _NATION).to_csv()
    return read_bytes(s, made).alias(Name="title").schema(Schema([Field("key", "int", ("Key",)), Field("title")])).load()


@query("q_index_before_name", "select n_name as v, n_regionkey as r, cast(null as varchar) as missing from nation")
def _(s, d):
    made = write(table(s, d, "nation"), ["n_nationkey"], _NATION).to_csv()
    return read_bytes(s, made).schema(Schema([Field("v", heads=("Key",), index=1), Field("r", "int", ("Region",)), Field("missing", heads=("No",))])).load()


@query("q_multi_level_head", "select n_nationkey, n_name from nation")
def _(s, d):
    schema = Schema([Field("n_nationkey", "int", ("Top", "Key")), Field("n_name", "string", ("Top", "Name"))])
    made = write(table(s, d, "nation"), ["n_nationkey"], schema).to_xlsx()
    return read_bytes(s, made).head_rows(2).schema(schema).load()


@query("q_extras", "select 'MERGE' as type, 0::bigint as first_row, 0::bigint as last_row, 0::bigint as first_col, 1::bigint as last_col union all select 'MERGE', 2 + n_nationkey, 3 + n_nationkey, 1, 1 from nation where n_nationkey % 2 = 0")
def _(s, d):
    schema = Schema([Field("n_nationkey", "int", ("Top", "Key")), Field("n_name", "string", ("Top", "Name"))])
    made = write(table(s, d, "nation"), ["n_nationkey"], schema, loop_merges=[(2, 1, 1)]).to_xlsx()
    return read_bytes(s, made).extras("MERGE").select("type", "first_row", "last_row", "first_col", "last_col")


@query("q_tables_in_sheet", "select 0::bigint as _row, 'Key' as first union all select 1 + n_nationkey, cast(n_nationkey as varchar) from nation union all select 26, 'r_regionkey' union all select 27 + r_regionkey, cast(r_regionkey as varchar) from region")
def _(s, d):
    book = Workbook().write(write(table(s, d, "nation"), ["n_nationkey"], _NATION, sheet="t")).write(write(table(s, d, "region"), ["r_regionkey"], sheet="t"), table=True)
    return read_bytes(s, book.finish()).head_rows(0).dynamic().select("_row", F.element_at("values", F.lit(0)).alias("first"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
