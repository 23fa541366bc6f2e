"""Relation graphs derived from ordinary tables, as SQL that Spark and other engines run alike.

`{customer}` and so on stand for the tables. All graphs have the columns of an edge table.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

#: `ord` is a table's number times SPACE, plus a rank of its rows below SPACE: the key, or for two keys together the first
#: times WIDTH plus the second. With TPC-H keys that holds up to a scale factor of 200.
SPACE, WIDTH = 500_000_000_000_000_000, 40_000_000
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def _definition(table: str, prefix: str, key: str, base: int) -> str:
    file = f"'{table}/{prefix}' || cast({key} as varchar(30)) || '.row'"
    return f"select 'definition' as kind, {file} as source, '{prefix}' || cast({key} as varchar(30)) as target, 'exact' as confidence, {file} as file, 1 as line, 1 as col, cast({base} as bigint) * {SPACE} + {key} as ord from {{{table}}}"


def _call(table: str, name: str, target: str, rank: str, line: int, base: int) -> str:
    """Calls of a table's rows; a row that repeats calls once."""
    file = f"'{table}/' || {name} || '.row'"
    return f"select distinct 'call' as kind, {file} as source, {target} as target, 'exact' as confidence, {file} as file, {line} as line, 5 as col, cast({base} as bigint) * {SPACE} + {rank} as ord from {{{table}}}"


def _s(x: str) -> str:
    return f"cast({x} as varchar(30))"


_LINE = f"'l' || {_s('l_orderkey')} || 'x' || {_s('l_linenumber')}"

_ITEM = "cast(l_orderkey as bigint) * 10 + l_linenumber"

#: Foreign keys: a row defines its key and calls the keys that it refers to. Acyclic, four hops deep.
FOREIGN_KEYS = " union all ".join(
    [
        _definition("region", "r", "r_regionkey", 1),
        _definition("nation", "n", "n_nationkey", 2),
        _definition("customer", "c", "c_custkey", 3),
        _definition("supplier", "s", "s_suppkey", 4),
        _definition("part", "p", "p_partkey", 5),
        _definition("orders", "o", "o_orderkey", 6),
        _call("nation", f"'n' || {_s('n_nationkey')}", f"'r' || {_s('n_regionkey')}", "n_nationkey", 2, 11),
        _call("customer", f"'c' || {_s('c_custkey')}", f"'n' || {_s('c_nationkey')}", "c_custkey", 2, 12),
        _call("supplier", f"'s' || {_s('s_suppkey')}", f"'n' || {_s('s_nationkey')}", "s_suppkey", 2, 13),
        _call("orders", f"'o' || {_s('o_orderkey')}", f"'c' || {_s('o_custkey')}", "o_orderkey", 2, 14),
        _call("lineitem", _LINE, f"'o' || {_s('l_orderkey')}", _ITEM, 2, 15),
        _call("lineitem", _LINE, f"'p' || {_s('l_partkey')}", f"({_ITEM}) * {WIDTH} + l_partkey", 3, 16),
        _call("lineitem", _LINE, f"'s' || {_s('l_suppkey')}", f"({_ITEM}) * {WIDTH} + l_suppkey", 4, 17),
    ]
)

#: Methods of nations, called by line items under full and short names: every way in which a call can resolve.
METHODS = " union all ".join(
    [
        f"select distinct 'definition' as kind, 'nation/n' || {_s('s_nationkey')} || '.row' as source, 'N' || {_s('s_nationkey')} || '.m' || {_s('s_suppkey % 7')} as target, 'exact' as confidence, "
        f"'nation/n' || {_s('s_nationkey')} || '.row' as file, cast(2 + s_suppkey % 7 as int) as line, 3 as col, cast(s_nationkey * 100 + s_suppkey % 7 as bigint) as ord from {{supplier}}",
        f"select 'definition', 'nation/n' || {_s('n_nationkey')} || '.row', 'N' || {_s('n_nationkey')} || '.u' || {_s('n_nationkey')}, 'exact', 'nation/n' || {_s('n_nationkey')} || '.row', 20, 3, cast(n_nationkey * 100 + 50 as bigint) from {{nation}}",
        f"select 'definition', 'region/fn' || {_s('r_regionkey')} || '.row', 'fn' || {_s('r_regionkey')}, 'exact', 'region/fn' || {_s('r_regionkey')} || '.row', 1, 1, cast(100000 + r_regionkey as bigint) from {{region}}",
        f"select 'call', 'nation/n' || {_s('l_partkey % 25')} || '.row', case l_linenumber % 4 when 0 then 'm' || {_s('l_suppkey % 9')} when 1 then 'u' || {_s('l_suppkey % 30')} when 2 then 'fn' || {_s('l_suppkey % 7')} else 'm' || {_s('l_partkey % 7')} end, "
        f"'inferred', 'nation/n' || {_s('l_partkey % 25')} || '.row', 30, 5, cast(1000000 + l_orderkey * 10 + l_linenumber as bigint) from {{lineitem}}",
    ]
)

#: Users calling the user of the next event of the same type on the same day: cycles of all lengths.
EVENTS = " union all ".join(
    [
        f"select distinct 'definition' as kind, 'user/u' || {_s('user_id')} || '.row' as source, 'u' || {_s('user_id')} as target, 'exact' as confidence, 'user/u' || {_s('user_id')} || '.row' as file, 1 as line, 1 as col, cast(user_id as bigint) as ord from {{events}}",
        f"select 'call', 'user/u' || {_s('user_id')} || '.row', 'u' || {_s('next_user')}, 'exact', 'user/u' || {_s('user_id')} || '.row', cast(event_id as int), 1, cast(1000000000 + event_id as bigint) "
        "from (select event_id, user_id, lead(user_id) over (partition by event_type, cast(ts as date) order by ts, event_id) as next_user from {events}) e where next_user is not null",
    ]
)

_HALF = _s("cast(floor(doc_id / 2) as bigint)")

#: Documents calling the one with half their number, under names with slashes and dots.
PATHS = (
    f"select 'call' as kind, 'd/x' || {_s('doc_id')} || '.ts' as source, case doc_id % 3 when 0 then 'lib/x' || {_HALF} when 1 then 'Ns.X' || {_HALF} else 'x' || {_HALF} end as target, "
    f"'exact' as confidence, 'd/x' || {_s('doc_id')} || '.ts' as file, 1 as line, 1 as col, cast(doc_id as bigint) as ord from {{documents}}"
)

#: Documents as files with paths of many shapes.
FILES = (
    "select doc_id, text, cast(octet_length(encode(text)) as bigint) as size, "
    "case doc_id % 9 when 0 then 'src/' when 1 then 'tests/' when 2 then 'node_modules/x/' when 3 then 'packages/app/src/' when 4 then 'dist/' when 5 then 'lib/generated/' when 6 then 'a/__tests__/' when 7 then 'vendor2/' else '' end "
    f"|| source || '/' || lang || {_s('doc_id')} || "
    "case doc_id % 7 when 0 then '.ts' when 1 then '.PY' when 2 then '.md' when 3 then '.spec.ts' when 4 then '.go' when 5 then '.mjs' else '' end as path from {documents}"
)



def for_spark(sql: str, sf_dir: str) -> str:
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", f"parquet.`{sf_dir}/{t}.parquet`")
    return sql.replace("octet_length(encode(text))", "octet_length(text)")


def for_views(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql


def graph(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived graph or file table."""
    return spark.sql(for_spark(sql, sf_dir))
