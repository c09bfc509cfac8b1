"""Reconciliation fixtures built from the driver tables (see FIXTURES.md).

Each side is plain SQL that runs unchanged in Spark SQL (UTC) and DuckDB on
views of the driver tables; the same text feeds the Spark queries and the
oracle. All fixture columns are strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tally.spec import ReconSpec

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@dataclass(frozen=True)
class Fixture:
    name: str
    source_sql: str
    target_sql: str
    source_cols: tuple[str, ...]
    target_cols: tuple[str, ...]
    spec: ReconSpec
    tables: tuple[str, ...]


def _identity(cols):
    return tuple((c, c) for c in cols)


ORDERS_SRC = """select cast(o_orderkey as string) as order_id, cast(o_custkey as string) as customer, o_orderstatus as status,
  case when o_orderkey%83=0 then '' else cast(cast(o_totalprice as decimal(18,2)) as string) end as total,
  cast(cast(o_orderdate as date) as string)||' 00:00:00' as order_date, o_orderpriority as priority
from orders where o_orderkey%101<>0"""

ORDERS_TGT = """select case when o_orderkey%5=0 then cast(o_orderkey as string)||'.0'
            when o_orderkey%6=0 then '  '||cast(o_orderkey as string)||' '
            else cast(o_orderkey as string) end as order_no,
  cast(o_custkey as string) as cust_no,
  case when o_orderkey%13=0 then lower(o_orderstatus) when o_orderkey%17=0 then '  '||o_orderstatus||' ' else o_orderstatus end as order_status,
  case when o_orderkey%83=0 or o_orderkey%89=0 then ''
       when o_orderkey%97=0 then cast(cast(o_totalprice+1 as decimal(18,2)) as string)
       when o_orderkey%7=0 then cast(cast(o_totalprice as decimal(18,2)) as string)||'0'
       else cast(cast(o_totalprice as decimal(18,2)) as string) end as amount,
  substr(d,9,2)||'/'||substr(d,6,2)||'/'||substr(d,1,4) as ordered_on,
  case when o_orderkey%23=0 then null when o_orderkey%19=0 then o_orderpriority||'!' else o_orderpriority end as prio
from (select *, case when o_orderkey%29=0 then cast(cast(cast(o_orderdate as date) + interval '1' day as date) as string)
                     else cast(cast(o_orderdate as date) as string) end as d from orders) x
where o_orderkey%103<>0"""

LINES_SRC = """select cast(l_orderkey as string) as ok, cast(l_linenumber as string) as ln, cast(l_partkey as string) as pk, cast(l_suppkey as string) as sk,
  cast(cast(l_quantity as decimal(18,2)) as string) as qty, cast(cast(l_extendedprice as decimal(18,2)) as string) as price, l_returnflag as rf
from lineitem"""

LINES_TGT = """select cast(l_orderkey as string) as ok, cast(l_linenumber as string) as ln, cast(l_partkey as string) as pk, cast(l_suppkey as string) as sk,
  cast(cast(l_quantity + case when l_partkey%53=0 then 1 else 0 end as decimal(18,2)) as string) as qty,
  cast(cast(l_extendedprice as decimal(18,2)) as string) as price,
  case when l_suppkey%31=0 then lower(l_returnflag) else l_returnflag end as rf
from lineitem where l_partkey%101<>0"""

_BALANCE = """case when c_custkey%4=0 then '-' else '' end||cast(cast(abs(c_acctbal) as decimal(18,2)) as string)"""

CUST_SRC = f"""select cast(c_custkey as string) as id, c_name as name, {_BALANCE} as bal, c_mktsegment as seg
from customer"""

CUST_TGT = f"""select cast(c_custkey as string) as id, c_name as name, {_BALANCE}||'0' as bal, c_mktsegment as seg
from customer"""

# One key column that repeats, no order given, an unmapped column on the target only.
DUPS_SRC = """select cast(l_orderkey as string) as ok, cast(l_partkey as string) as pk,
  cast(cast(l_extendedprice as decimal(18,2)) as string) as price, l_returnflag as rf from lineitem"""

DUPS_TGT = """select cast(l_orderkey as string) as ok, cast(l_partkey as string) as pk, cast(l_suppkey as string) as extra,
  cast(cast(l_extendedprice + case when l_partkey%59=0 then 1 else 0 end as decimal(18,2)) as string) as price, l_returnflag as rf
from lineitem"""

# A third of all rows under one key.
HOT_SRC = """select case when l_orderkey%3=0 then 'hot' else cast(l_orderkey as string) end as ok, cast(l_partkey as string) as pk,
  cast(cast(l_extendedprice as decimal(18,2)) as string) as price from lineitem"""

HOT_TGT = """select case when l_orderkey%3=0 then 'hot' else cast(l_orderkey as string) end as ok, cast(l_partkey as string) as pk,
  cast(cast(l_extendedprice + case when l_partkey%61=0 then 1 else 0 end as decimal(18,2)) as string) as price from lineitem
where l_partkey%107<>0"""

# A third of all rows under one key, in few different rows: long runs of equal ones on both sides.
RUNS_SRC = """select case when l_orderkey%3=0 then 'hot' else cast(l_orderkey as string) end as ok,
  case when l_orderkey%3=0 then cast(l_linenumber%3 as string) else cast(l_partkey as string) end as pk,
  case when l_orderkey%3=0 then l_returnflag else cast(cast(l_extendedprice as decimal(18,2)) as string) end as price from lineitem"""

RUNS_TGT = """select case when l_orderkey%3=0 then 'hot' else cast(l_orderkey as string) end as ok,
  case when l_orderkey%3=0 then cast(l_linenumber%3 as string) else cast(l_partkey as string) end as pk,
  case when l_orderkey%3=0 then case when l_partkey%211=0 then lower(l_returnflag) else l_returnflag end
       else cast(cast(l_extendedprice + case when l_partkey%61=0 then 1 else 0 end as decimal(18,2)) as string) end as price from lineitem
where l_partkey%107<>0"""

# Rows whose order is that of the files they are written to (``ord``, which the files do not hold), with quoted line ends.
_FILE_ORD = """lpad(cast(100-l_linenumber as string),3,'0')||'-'||lpad(cast(l_partkey as string),10,'0')||'-'||
  lpad(cast(l_suppkey as string),10,'0')||'-'||lpad(cast(cast(l_extendedprice as decimal(18,2)) as string),14,'0')||'-'||l_returnflag"""

FILES_SRC = f"""select cast(l_orderkey as string) as ok, cast(l_partkey as string) as pk,
  cast(cast(l_extendedprice as decimal(18,2)) as string) as price, 'say "'||l_returnflag||'",'||chr(10)||'"' as note, {_FILE_ORD} as ord from lineitem"""

FILES_TGT = f"""select cast(l_orderkey as string) as ok, cast(l_partkey as string) as pk,
  cast(cast(l_extendedprice + case when l_partkey%59=0 then 1 else 0 end as decimal(18,2)) as string) as price,
  case when l_suppkey%29=0 then 'say '||chr(10) else 'say "'||l_returnflag||'",'||chr(10)||'"' end as note, {_FILE_ORD} as ord
from lineitem where l_partkey%97<>0"""

# Cells that a careless text file would spoil: blanks at both ends, quotes, commas, line ends, backslashes.
TEXTS_SRC = """select cast(o_orderkey as string) as id, '  '||o_orderpriority||' "x", '||chr(92)||' ' as note,
  o_orderstatus as status from orders"""

TEXTS_TGT = """select cast(o_orderkey as string) as id,
  case when o_orderkey%7=0 then '"'||o_orderpriority||'"'||chr(10)||'z, ' when o_orderkey%11=0 then ''
       else '  '||o_orderpriority||' "x", '||chr(92)||' ' end as note,
  case when o_orderkey%13=0 then '" '||o_orderstatus else o_orderstatus end as status from orders"""

CONV_SRC = """select cast(conv_id as string) as conv_id, cast(turn as string) as turn, role, text from conversations"""

CONV_TGT = """select cast(conv_id as string) as conv_id, cast(turn as string) as turn, upper(role) as role,
  case when conv_id%7=0 then replace(text,' ',chr(160)||' ') when conv_id%11=0 then text||' x' else text end as text
from conversations where conv_id%13<>0 or turn<>0"""

EVENTS_SRC = """select cast(event_id as string) as event_id, substr(cast(ts as string),1,19) as ts, event_type,
  cast(cast(value as decimal(18,2)) as string) as value, props from events"""

EVENTS_TGT = """select cast(event_id as string) as event_id,
  substr(cast(ts + case when event_id%37=0 then interval '1' day else interval '0' day end as string),1,10)||' 00:00:00' as ts, event_type,
  cast(cast(value as decimal(18,2)) as string)||case when event_id%41=0 then '%' else '' end as value, props
from events"""

_ORDERS_MAP = (("order_id", "order_no"), ("customer", "cust_no"), ("status", "order_status"),
               ("total", "amount"), ("order_date", "ordered_on"), ("priority", "prio"))
_LINES = ("ok", "ln", "pk", "sk", "qty", "price", "rf")
_CUST = ("id", "name", "bal", "seg")
_DUPS = ("ok", "pk", "price", "rf")
_HOT = ("ok", "pk", "price")
_TEXTS = ("id", "note", "status")
_FILES = ("ok", "pk", "price", "note")
_CONV = ("conv_id", "turn", "role", "text")
_EVENTS = ("event_id", "ts", "event_type", "value", "props")

FIXTURES: dict[str, Fixture] = {
    "orders": Fixture("orders", ORDERS_SRC, ORDERS_TGT, tuple(s for s, _ in _ORDERS_MAP), tuple(t for _, t in _ORDERS_MAP),
                      ReconSpec(mappings=_ORDERS_MAP, key_columns=("order_id",), include_columns=("customer",),
                                source_name="orders_src", target_name="orders_tgt"), ("orders",)),
    "lines": Fixture("lines", LINES_SRC, LINES_TGT, _LINES, _LINES,
                     ReconSpec(mappings=_identity(_LINES), key_columns=("ok", "ln"), order_by=("pk", "sk", "price"),
                               source_name="lines_src", target_name="lines_tgt"), ("lineitem",)),
    "cust": Fixture("cust", CUST_SRC, CUST_TGT, _CUST, _CUST,
                    ReconSpec(mappings=_identity(_CUST), key_columns=("id",),
                              source_name="cust_src", target_name="cust_tgt"), ("customer",)),
    "dups": Fixture("dups", DUPS_SRC, DUPS_TGT, _DUPS, ("ok", "pk", "extra", "price", "rf"),
                    ReconSpec(mappings=_identity(_DUPS), key_columns=("ok",),
                              source_name="dups_src", target_name="dups_tgt"), ("lineitem",)),
    "hot": Fixture("hot", HOT_SRC, HOT_TGT, _HOT, _HOT,
                   ReconSpec(mappings=_identity(_HOT), key_columns=("ok",),
                             source_name="hot_src", target_name="hot_tgt"), ("lineitem",)),
    "runs": Fixture("runs", RUNS_SRC, RUNS_TGT, _HOT, _HOT,
                    ReconSpec(mappings=_identity(_HOT), key_columns=("ok",),
                              source_name="runs_src", target_name="runs_tgt"), ("lineitem",)),
    "files": Fixture("files", FILES_SRC, FILES_TGT, (*_FILES, "ord"), (*_FILES, "ord"),
                     ReconSpec(mappings=_identity(_FILES), key_columns=("ok",), order_by=("ord",),
                               source_name="files_src", target_name="files_tgt"), ("lineitem",)),
    "texts": Fixture("texts", TEXTS_SRC, TEXTS_TGT, _TEXTS, _TEXTS,
                     ReconSpec(mappings=_identity(_TEXTS), key_columns=("id",),
                               source_name="texts_src", target_name="texts_tgt"), ("orders",)),
    "conv": Fixture("conv", CONV_SRC, CONV_TGT, _CONV, _CONV,
                    ReconSpec(mappings=_identity(_CONV), key_columns=("conv_id", "turn"),
                              source_name="conv_src", target_name="conv_tgt"), ("conversations",)),
    "events": Fixture("events", EVENTS_SRC, EVENTS_TGT, _EVENTS, _EVENTS,
                      ReconSpec(mappings=_identity(_EVENTS), key_columns=("event_id",),
                                source_name="events_src", target_name="events_tgt"), ("events",)),
}


def register_tables(spark: SparkSession, sf_dir: str, tables=TABLES) -> None:
    """Temp views over the driver parquet tables (lazy: nothing is read).

    The fixture SQL renders timestamps as text, which depends on the session
    time zone; fixtures are defined in UTC (as the SQL oracle reads them)."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for t in tables:
        spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet").createOrReplaceTempView(t)


def load(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame, Fixture]:
    fx = FIXTURES[name]
    register_tables(spark, sf_dir, fx.tables)
    return spark.sql(fx.source_sql), spark.sql(fx.target_sql), fx
