"""Queries over graphs and files derived from the tables: (spark, sf_dir) -> DataFrame, with the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract.registry import extract_files
from .extract.samples import SAMPLES
from .functions import names, paths
from .model import EXCLUDED_DIRECTORIES, EXTENSION_LANGUAGE, SCANNED_EXTENSIONS, Query, ScanLimits
from .operators import present, resolve, target, walk
from .plans import derive, engine
from .plans.index import fingerprint_changes, merged
from .plans.settle import shared_folder
from .sources import files as scans
from .sources.snapshot import SnapshotStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_FK, _METHODS, _EVENTS, _FILES = (derive.for_views(x) for x in (derive.FOREIGN_KEYS, derive.METHODS, derive.EVENTS, derive.FILES))


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.graph(spark, sf_dir, derive.FOREIGN_KEYS)


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.graph(spark, sf_dir, derive.METHODS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.graph(spark, sf_dir, derive.EVENTS)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.graph(spark, sf_dir, derive.FILES)


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- Scans

_EXT = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]*)$', 1))"


@query(f"select path, {_EXT} as ext from ({_FILES}) f where {_EXT} in ({_in(SCANNED_EXTENSIONS)})")
def scan_ext_filter(spark, sf_dir):
    files = _files(spark, sf_dir)
    return files.where(scans.scanned_extension(F.col("path"))).select("path", paths.extension(F.col("path")).alias("ext"))


@query(f"select path from ({_FILES}) f where len(list_intersect(string_split(path, '/')[1:-2], [{_in(EXCLUDED_DIRECTORIES)}])) = 0")
def scan_excluded_dirs(spark, sf_dir):
    return _files(spark, sf_dir).where(~scans.in_excluded_directory(F.col("path"))).select("path")


@query(rf"select path from ({_FILES}) f where not (path like 'lib/generated/%' or lower(path) like '%.md' or regexp_matches(path, '^src/src1.*(/.*)?$') or len(list_filter(string_split(path, '/'), lambda s: regexp_matches(s, '^src/src1.*(/.*)?$'))) > 0)")
def scan_exclude_glob(spark, sf_dir):
    rules = ("./lib/generated/", "**/*.md", "src/src1*")
    return _files(spark, sf_dir).where(~scans.any_rule(F.col("path"), rules)).select("path")


@query(f"select path from ({_FILES}) f where {_EXT} in ({_in(SCANNED_EXTENSIONS)}) or lower(path) like '%.mjs' or path like 'vendor2/%'")
def scan_include_glob(spark, sf_dir):
    path = F.col("path")
    return _files(spark, sf_dir).where(scans.scanned_extension(path) | scans.any_rule(path, ("**/*.mjs", "vendor2"))).select("path")


_IGNORE = ("vendor*", "/generated", "tests/")


@query(f"""select path from (select path, string_split(path, '/')[1:-2] as dirs from ({_FILES}) f) d
    where len(list_filter(dirs, lambda s: s like 'vendor%' or s = 'generated' or s = 'tests')) = 0""")
def scan_gitignore(spark, sf_dir):
    lines = scans.ignore_lines("# rules\n\n" + "\n".join(_IGNORE))
    return _files(spark, sf_dir).where(~scans.ignored(F.col("path"), lines)).select("path")


@query(f"select path, size, case when size > 4000 then 'file_oversize' end as skip from ({_FILES}) f")
def scan_oversize(spark, sf_dir):
    limits = ScanLimits(max_file_bytes=4000)
    files = _files(spark, sf_dir)
    return files.select("path", "size", scans.skip_code(F.col("size"), F.col("text").cast("binary"), limits).alias("skip"))


_DAMAGED = "case doc_id % 5 when 0 then repeat(chr(1), 40) || text when 1 then repeat(chr(2), 3) || text else text end"


@query(f"""select path, control > 0.06 as is_binary from (select path, len(regexp_replace(body, '[^\\x01-\\x06]', '', 'g')) / least(8192, octet_length(encode(body))) as control
    from (select path, {_DAMAGED} as body from ({_FILES}) f) b) c""")
def scan_binary(spark, sf_dir):
    body = F.expr(_DAMAGED).cast("binary")
    return _files(spark, sf_dir).select("path", scans.looks_binary(body).alias("is_binary"))


@query(f"select path, doc_id % 4 in (0, 1) as undecodable from ({_FILES}) f")
def scan_decode(spark, sf_dir):
    content = F.col("text").cast("binary")
    mark = F.pmod("doc_id", F.lit(4))
    bad = F.when(mark == 0, F.concat(content, F.unhex(F.lit("C328")))).when(mark == 1, F.concat(content, F.unhex(F.lit("EFBFBD"))))
    content = F.coalesce(bad, F.when(mark == 2, F.concat(F.unhex(F.lit("EFBBBF")), content, F.unhex(F.lit("C328")))), content)
    return _files(spark, sf_dir).select("path", scans.undecodable(content).alias("undecodable"))


@query(f"""with e as (select path from ({_FILES}) f where {_EXT} in ({_in(SCANNED_EXTENSIONS)}) and len(list_intersect(string_split(path, '/')[1:-2], [{_in(EXCLUDED_DIRECTORIES)}])) = 0)
    select path from (select path, row_number() over (order by encode(path)) as n from e) r where n <= 40""")
def scan_count_stop(spark, sf_dir):
    limits = ScanLimits(max_files=40)
    return scans.within_budget(scans.eligible(_files(spark, sf_dir), limits), limits).select("path")


_MANIFESTS = "select case doc_id % 8 when 0 then 'packages/' when 1 then 'libs/' when 2 then 'other/' when 3 then 'packages/x' || lang || '/' when 4 then 'apps/a/b/c/' else '' end || case when doc_id % 8 < 5 then source || '/' else '' end || case when doc_id % 3 = 0 then 'README.md' else 'package.json' end as path, '{\"name\": \"@repo/' || source || '\"}' as text from documents"


@query(f"""with m as (select distinct path, text from ({_MANIFESTS}) x), p as (select regexp_replace(path, '/?package.json$', '') as dir, '@repo/' || regexp_extract(text, 'repo/([a-z0-9]+)', 1) as name,
    len(string_split(path, '/')) as n from m where path like '%package.json' and (path = 'package.json' or (split_part(path, '/', 1) in ('packages', 'libs', 'apps', 'pkg') and len(string_split(path, '/')) in (3, 4))))
    select dir, name from p where n < 4 or regexp_replace(dir, '/[^/]*$', '') not in (select dir from p)""")
def package_discovery(spark, sf_dir):
    from .sources.packages import discover

    manifests = spark.sql(_MANIFESTS.replace("from documents", f"from parquet.`{sf_dir}/documents.parquet`")).distinct()
    return discover(manifests).select("dir", "name")


_PACKAGES = ("packages/app", "packages", "src", "src/src1", "lib/generated/src2", "a/__tests__")


@query(f"""select path as file, max_by(dir, length(dir)) as package_dir from ({_FILES}) f left join (select unnest([{_in(_PACKAGES)}]) as dir) p on starts_with(path, dir || '/') group by path""")
def package_longest_prefix(spark, sf_dir):
    packages = spark.createDataFrame([(d,) for d in _PACKAGES], "dir string")
    return resolve.package_of(_files(spark, sf_dir).select(F.col("path").alias("file")), packages)


# --- Paths, names and predicates


@query()
def path_normalize(spark, sf_dir):
    """Page addresses as paths with `.` and `..` (the twin of the expression is tested in Python)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/./x/../../y//z/"))
    return pages.select("page_id", raw.alias("raw"), paths.normalized(raw).alias("path"))


@query(f"""select path, case {_EXT} {' '.join(f"when '{e}' then '{n}'" for e, n in EXTENSION_LANGUAGE.items())} else lower(regexp_extract(path, '[^.]*$')) end as language from ({_FILES}) f""")
def language_label(spark, sf_dir):
    return _files(spark, sf_dir).select("path", paths.language(F.col("path")).alias("language"))


@query(f"select target from (select distinct target from ({_METHODS}) m) t where lower(target) = 'm3' or lower(target) like '%/m3' or (not contains(target, '/') and instr(target, '.') > 1 and lower(string_split(target, '.')[-1]) = 'm3')")
def match_node_name(spark, sf_dir):
    return _methods(spark, sf_dir).select("target").distinct().where(names.matches_node(F.col("target"), "M3"))


@query(f"select target, count(*) as n from ({_METHODS}) m where lower(target) in ('n3.u3', 'u3') or lower(target) like '%.u3' or lower(target) like '%/u3' or lower(target) like '%.n3.u3' group by target")
def match_alias(spark, sf_dir):
    edges = _methods(spark, sf_dir)
    return edges.where(names.matches_alias(F.col("target"), names.aliases_for("u3", "N3.u3"))).groupBy("target").agg(F.count("*").alias("n"))


@query(f"select distinct target, case when contains(target, '.') then string_split(target, '.')[-1] else target end as short from ({_METHODS}) m")
def walk_name(spark, sf_dir):
    return _methods(spark, sf_dir).select("target", names.short_name(F.col("target")).alias("short")).distinct()


@query(rf"select path, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]+$', '')) as caller from ({_FILES}) f")
def caller_symbol(spark, sf_dir):
    return _files(spark, sf_dir).select("path", names.caller_symbol(F.col("path")).alias("caller"))


@query(f"select path, (path like 'tests/%' or path like '%/tests/%' or path like '%/__tests__/%' or lower(regexp_extract(path, '[^/]*$')) like '%.spec.%') as is_test from ({_FILES}) f")
def is_test_path(spark, sf_dir):
    return _files(spark, sf_dir).select("path", names.is_test_path(F.col("path")).alias("is_test"))


@query(f"""with p as (select string_split(lower(path), '/') as parts from ({_FILES}) f)
    select unnest(list_distinct(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[i:], '/')))) as key, count(*) as n from p group by 1""")
def symbol_keys(spark, sf_dir):
    keys = _files(spark, sf_dir).select(F.explode(names.symbol_keys(F.col("path"), False)).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))


@query(f"select kind, count(*) as n from ({_FK}) e where kind in ('call', 'definition') group by kind")
def kind_filter(spark, sf_dir):
    return engine.filtered(_fk(spark, sf_dir), Query("callers"), {}).groupBy("kind").agg(F.count("*").alias("n"))


# --- Resolution

_RESOLVED = f"""
    e as (select * from ({_METHODS}) m),
    d as (select lower(target) as name_full, target, file, case when contains(target, '.') then lower(string_split(target, '.')[-1]) end as name_short from e where kind = 'definition'),
    c as (select row_number() over () as id, target, confidence, file, lower(target) as t from e where kind = 'call'),
    k as (select c.id, any_value(c.target) as target, any_value(c.confidence) as confidence, any_value(c.file) as file,
          count(*) filter (where name_full = t) as n_full, count(*) filter (where name_short = t) as n_all, count(*) filter (where name_short = t and d.file = c.file) as n_own,
          min(d.target) filter (where name_short = t) as t_all, min(d.target) filter (where name_short = t and d.file = c.file) as t_own
          from c left join d on name_full = t or name_short = t group by c.id),
    r as (select file, case when n_full > 0 then 'full' when n_all = 0 then 'none' when n_own = 1 then 'samefile' when n_all = 1 then 'unique' else 'multiple' end as branch, * exclude (id, file) from k),
    x as (select file, branch, case branch when 'samefile' then t_own when 'unique' then t_all else target end as target,
          case branch when 'full' then confidence when 'samefile' then 'exact' when 'unique' then 'inferred' else 'heuristic' end as confidence from r)
"""


@query(f"with {_RESOLVED} select file, branch, target, confidence from x")
def call_resolution(spark, sf_dir):
    out = resolve.resolve_calls(_methods(spark, sf_dir))
    return out.where("kind = 'call'").select("file", "branch", "target", "confidence")


@query(f"with {_RESOLVED} select branch, confidence, count(*) as n from x group by branch, confidence")
def call_resolution_counts(spark, sf_dir):
    out = resolve.resolve_calls(_methods(spark, sf_dir)).where("kind = 'call'")
    return out.groupBy("branch", "confidence").agg(F.count("*").alias("n"))


_IMPORTS = "select doc_id, 'pages/' || source || '/main.ts' as source, case doc_id % 5 when 0 then './' || lang when 1 then '../' || source || '/x/' || lang when 2 then './' || lang || '.js' when 3 then '@repo/' || source || '/' || lang else 'fs' end as specifier from documents"
_TARGETS = "select distinct 'pages/' || source || '/' || case when doc_id % 2 = 0 then lang || '.ts' else 'x/' || lang || '/index.ts' end as file from documents union select distinct 'packages/' || source || '/' || lang || '.tsx' from documents"


def _with_documents(spark, sf_dir, sql):
    return spark.sql(sql.replace("from documents", f"from parquet.`{sf_dir}/documents.parquet`"))


@query(f"""with i as ({_IMPORTS}), f as ({_TARGETS}), b as (select doc_id, case when specifier like '../%' then 'pages/' || substr(specifier, 4) else regexp_replace(source, '/main.ts$', '') || substr(specifier, 2) end as base from i where specifier like '.%'),
    l as (select unnest(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']) as step, unnest(range(9)) as pos)
    select doc_id, min_by(base || step, pos) as resolved from b, l where base || step in (select file from f) group by doc_id""")
def import_ladder(spark, sf_dir):
    imports = _with_documents(spark, sf_dir, _IMPORTS)
    asked = imports.select("doc_id", resolve.script_candidates(F.col("source"), F.col("specifier")).alias("candidates")).where("candidates is not null")
    return resolve.first_file(asked, _with_documents(spark, sf_dir, _TARGETS), "doc_id")


@query(f"""with i as ({_IMPORTS}), f as ({_TARGETS}), p as (select doc_id, 'packages/' || substr(specifier, 7) as base from i where specifier like '@repo/%'),
    l as (select unnest(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js']) as step, unnest(range(8)) as pos)
    select doc_id, min_by(base || step, pos) as resolved from p, l where base || step in (select file from f) group by doc_id""")
def import_package(spark, sf_dir):
    imports = _with_documents(spark, sf_dir, _IMPORTS).where("specifier not like '.%'")
    asked = imports.select("doc_id", "source", "specifier", F.lit(True).alias("script"), F.lit(".ts").alias("extension"))
    packages = _with_documents(spark, sf_dir, "select distinct 'packages/' || source as dir, '@repo/' || source as name, 1 as ord from documents")
    return resolve.resolve_imports(asked, _with_documents(spark, sf_dir, _TARGETS), packages, "doc_id")


_MEMBERS = "select 'f' || cast(l_partkey % 3 as varchar(9)) as file, 'T' || cast(l_partkey as varchar(20)) as type, 'm' || cast(l_suppkey % 40 as varchar(9)) as method from lineitem"
_WANTED = "select 'f' || cast(n_nationkey % 3 as varchar(9)) as file, 'I' || cast(n_nationkey % 5 as varchar(9)) as iface, 'm' || cast(n_nationkey % 13 as varchar(9)) as method from nation"


@query(f"""with t as (select distinct * from ({_MEMBERS}) x), i as (select distinct * from ({_WANTED}) y)
    select distinct i.file, iface, type from i join (select distinct file, type from t) o on i.file = o.file
    where not exists (select 1 from i j where j.file = i.file and j.iface = i.iface and not exists (select 1 from t where t.file = i.file and t.type = o.type and t.method = j.method))""")
def go_interface_division(spark, sf_dir):
    types = spark.sql(_MEMBERS.replace("from lineitem", f"from parquet.`{sf_dir}/lineitem.parquet`"))
    wanted = spark.sql(_WANTED.replace("from nation", f"from parquet.`{sf_dir}/nation.parquet`"))
    return resolve.covered_interfaces(wanted, types)


@query(f"with e as (select * from ({_METHODS}) m) select c.ord, c.file, c.target from e c where c.kind = 'call' and exists (select 1 from e d where d.kind = 'definition' and d.file = c.file and string_split(d.target, '.')[-1] = c.target)")
def typeref_semi(spark, sf_dir):
    edges = _methods(spark, sf_dir)
    own = edges.where("kind = 'definition'").select("file", names.short_name(F.col("target")).alias("target"))
    return edges.where("kind = 'call'").join(own, ["file", "target"], "left_semi").select("ord", "file", "target")


# --- Filters and targets


@query(f"with {_RESOLVED} select confidence, branch, count(*) as n from x where confidence = 'inferred' group by confidence, branch")
def confidence_filter(spark, sf_dir):
    edges = resolve.resolve_calls(_methods(spark, sf_dir))
    return engine.filtered(edges, Query("callers", relation="call", confidence="inferred"), {}).groupBy("confidence", "branch").agg(F.count("*").alias("n"))


@query(f"select kind, file, target from ({_METHODS}) m where kind = 'definition' and file like 'nation/%'")
def scope_filter(spark, sf_dir):
    return engine.filtered(_methods(spark, sf_dir), Query("callers", relation="definition", scope="nation"), {"x/y": "package"}).select("kind", "file", "target")


@query(f"select target, file, line from ({_METHODS}) m where kind = 'definition' and file = 'nation/n3.row' and line = 20")
def target_file_line(spark, sf_dir):
    return target.at_line(_methods(spark, sf_dir), *target.parse_file_line("Nation/n3.row:20")).select("target", "file", "line")


@query(f"select target, file, line from ({_METHODS}) m where kind = 'definition' and file like 'region/%'")
def target_path_listing(spark, sf_dir):
    return target.under_path(_methods(spark, sf_dir), "Region/").select("target", "file", "line")


@query(f"select distinct lower(target) as name, lower(file) as file from ({_METHODS}) m where kind = 'definition' and lower(target) like '%.m3'")
def target_ambiguity(spark, sf_dir):
    return target.locations(target.named(_methods(spark, sf_dir), "m3"))


@query("select 'unknown_target' as code, 'no graph node matches ''nowhere''' as message")
def target_miss(spark, sf_dir):
    got = engine.answer(_methods(spark, sf_dir), Query("callers", "nowhere"))
    return spark.createDataFrame([(d["code"], d["message"]) for d in got.diagnostics], "code string, message string")


@query(f"""select cast(row_number() over (order by is_test, path, line, ord) as int) as place, name, path, language, line from (select target as name, file as path, 'row' as language, line, ord, 0 as is_test from ({_METHODS}) m
    where kind = 'definition' and lower(target) like '%.m3') c qualify place <= 50""")
def candidates_ranked(spark, sf_dir):
    got = target.candidate_answer(target.named(_methods(spark, sf_dir), "m3"), "m3", 50)
    rows = [(i, c["name"], c["path"], c["language"], c["line"]) for i, c in enumerate(got.candidates, 1)]
    return spark.createDataFrame(rows, "place int, name string, path string, language string, line int")


# --- Walks


def _rows(spark, found: walk.Selection) -> DataFrame:
    rows = [(i, r.kind, r.source, r.target, r.line) for i, r in enumerate(found.rows, 1)]
    return spark.createDataFrame(rows, "place int, kind string, source string, target string, line int").withColumn("total", F.lit(found.total))


@query(f"select cast(n as int) as place, kind, source, target, line, cast(total as int) as total from (select *, row_number() over (order by ord) as n, count(*) over () as total from ({_FK}) e where kind = 'call' and target = 'n3') r where n <= 50")
def callers_relation(spark, sf_dir):
    edges = _fk(spark, sf_dir)
    matching = engine.filtered(edges, Query("callers", "n3", relation="call"), {})
    return _rows(spark, walk.direct(matching, ["n3"], 50))


@query(f"""with recursive e as (select * from ({_FK}) g), calls as (select *, lower(regexp_replace(regexp_extract(source, '[^/]*$'), '\\.[^.]+$', '')) as caller from e where kind = 'call'),
    up(ord, caller) as (select ord, caller from calls where target = 'c7' union select c.ord, c.caller from up join calls c on c.target = up.caller)
    select kind, source, target, line from e where kind = 'definition' and target = 'c7' union all select kind, source, target, line from calls where ord in (select ord from up)""")
def callers_multi_hop(spark, sf_dir):
    edges = _fk(spark, sf_dir)
    found = walk.callers(edges, edges.where("target = 'c7'"), 200)
    return _rows(spark, found).select("kind", "source", "target", "line")


@query(f"""with e as (select * from ({_FK}) g where target = 'r0' and kind = 'definition' union all select * from ({_FK}) g where target = 'r0' and kind = 'call')
    select cast(row_number() over (order by case kind when 'definition' then 0 else 1 end, ord) as int) as place, kind, source, target, line, cast(count(*) over () as int) as total from e qualify place <= 3""")
def callers_budget(spark, sf_dir):
    edges = _fk(spark, sf_dir)
    return _rows(spark, walk.callers(edges, edges.where("target = 'r0'"), 3))


def _impact(graph: str, start: str, depth: int) -> str:
    return f"""with recursive calls as (select *, lower(regexp_replace(regexp_extract(source, '[^/]*$'), '\\.[^.]+$', '')) as caller from ({graph}) g where kind = 'call'),
    names(name, hop) as (select '{start}', 1 union select c.caller, n.hop + 1 from names n join calls c on c.target = n.name where n.hop < {depth}),
    first as (select name, min(hop) as hop from names group by name)"""


@query(f"{_impact(_FK, 'r0', 5)} select kind, source, target, line, cast(hop as int) as hop from calls join first on target = name")
def impact_edges(spark, sf_dir):
    return walk.upstream(_fk(spark, sf_dir), "r0", 5).select("kind", "source", "target", "line", "hop")


@query(f"""{_impact(_FK, 'n4', 5)}, layer as (select caller, min(hop) as hop from calls join first on target = name group by caller) select case when hop = 1 then 'direct' else 'transitive' end as layer, count(*) as n, min(caller) as first_name from layer group by 1""")
def impact_layers(spark, sf_dir):
    direct, transitive = walk.impact_layers(walk.upstream(_fk(spark, sf_dir), "n4", 5))
    rows = [("direct", len(direct), min(direct)), ("transitive", len(transitive), min(transitive))]
    return spark.createDataFrame(rows, "layer string, n long, first_name string")


@query(f"{_impact(_EVENTS, 'u3', 6)} select kind, source, target, line, cast(hop as int) as hop from calls join first on target = name")
def impact_cycle(spark, sf_dir):
    return walk.upstream(_events(spark, sf_dir), "u3", 6).select("kind", "source", "target", "line", "hop")


@query(f"select kind, source, target, line, 1 as hop from ({_FK}) e where kind = 'call' and target = 'r0'")
def impact_depth_1(spark, sf_dir):
    return walk.upstream(_fk(spark, sf_dir), "r0", 1).select("kind", "source", "target", "line", "hop")


_START = "select min(o_orderkey) as k from {orders} o join {customer} c on o_custkey = c_custkey join {nation} n on c_nationkey = n_nationkey where n_regionkey = 0"


@query(f"""with recursive calls as (select *, lower(regexp_replace(regexp_extract(source, '[^/]*$'), '\\.[^.]+$', '')) as caller from ({_FK}) g where kind = 'call'),
    up(ord, caller, chain, n) as (select ord, caller, [ord], 1 from calls where target = 'r0' union all select c.ord, c.caller, list_append(chain, c.ord), n + 1 from up join calls c on c.target = up.caller where n < 5),
    best as (select chain, n from up where caller = (select 'o' || k from ({derive.for_views(_START)}) s) order by n, chain limit 1)
    select cast(n - list_position(chain, ord) + 1 as int) as step, source, target, line from calls, best where list_contains(chain, ord)""")
def reachability_path(spark, sf_dir):
    start = derive.graph(spark, sf_dir, _START).first().k
    found = walk.reach(_fk(spark, sf_dir), f"o{start}", "r0", 5)
    return found.select("step", "source", "target", "line")


@query("select 'no_path' as code, 'no call path from r0 to p1 within depth 5' as message")
def reachability_no_path(spark, sf_dir):
    got = engine.answer(_fk(spark, sf_dir), Query("reachability", "r0", path_to="p1"))
    return spark.createDataFrame([(d["code"], d["message"]) for d in got.diagnostics], "code string, message string")


@query(f"""select cast(total as int) as total, total > 50 as truncated, cast(least(total, 50) as int) as returned, (total - 50) || ' more relations beyond limit' as message from (select count(*) as total from ({_FK}) e where kind = 'call' and target = 's3') t""")
def limit_truncated_total(spark, sf_dir):
    got = engine.answer(_fk(spark, sf_dir), Query("callers", "s3", relation="call"))
    return spark.createDataFrame([(got.total, got.truncated, len(got.paths), got.diagnostics[-1]["message"])], "total int, truncated boolean, returned int, message string")


@query(f"""select cast(length(name) as int) as n, count(*) as edges from (select target as name from ({_FK}) e where kind = 'definition') d group by 1""")
def edges_without_target(spark, sf_dir):
    edges = engine.filtered(_fk(spark, sf_dir), Query("reachability"), {})
    return edges.groupBy(F.length("target").alias("n")).agg(F.count("*").alias("edges"))


# --- Presentation, refresh, snapshots


@query(f"""select doc_id, cast(line as int) as line, array_to_string(list_transform(string_split_regex(text, '\r?\n')[line:line + 2], lambda x: substr(x, 1, 10000)), chr(10)) as lines from (select doc_id, text, 1 + doc_id % 3 as line from ({_FILES}) f) t""")
def snippet_lines(spark, sf_dir):
    files = _files(spark, sf_dir).select("doc_id", "path", "text", (F.lit(1) + F.pmod("doc_id", F.lit(3))).cast("int").alias("line"))
    edges = files.select("doc_id", F.col("path").alias("file"), "line")
    return present.with_snippets(edges, files).select("doc_id", "line", F.array_join("lines", "\n").alias("lines"))


@query(f"""select code, count(*) as n from (select case when size > 4000 then 'file_oversize' when case doc_id % 5 when 0 then 40 when 1 then 3 else 0 end / size > 0.06 then 'file_binary' end as code from ({_FILES.replace('octet_length(encode(text))', 'octet_length(encode(' + _DAMAGED + '))')}) f) d where code is not null group by code""")
def diagnostics_rollup(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("content", F.expr(_DAMAGED).cast("binary"))
    code = scans.skip_code(F.octet_length("content").cast("long"), F.col("content"), ScanLimits(max_file_bytes=4000))
    return files.select(code.alias("code")).where("code is not null").groupBy("code").agg(F.count("*").alias("n"))


#: Two listings: the events of a user on a day are a file, and time has moved on between them.
_STATE = "select 'u' || cast(user_id as varchar(20)) || '/' || cast(cast(ts as date) as varchar(20)) as path, count(*) as size, cast(max(event_id) as double) as mtime_ms from {events} "
_BEFORE = _STATE + "where event_id < (select max(event_id) * 0.8 from {events}) group by user_id, cast(ts as date)"
_NOW = _STATE + "where event_id > (select max(event_id) * 0.2 from {events}) group by user_id, cast(ts as date)"


@query(f"""with a as ({derive.for_views(_NOW)}), b as ({derive.for_views(_BEFORE)}) select coalesce(a.path, b.path) as path, case when a.path is null then 'deleted' else 'changed' end as change
    from a full join b on a.path = b.path where a.path is null or b.path is null or a.size <> b.size or a.mtime_ms <> b.mtime_ms""")
def fingerprint_diff(spark, sf_dir):
    return fingerprint_changes(derive.graph(spark, sf_dir, _NOW), derive.graph(spark, sf_dir, _BEFORE))


@query(derive.for_views(_NOW))
def incremental_merge(spark, sf_dir):
    now, before = derive.graph(spark, sf_dir, _NOW), derive.graph(spark, sf_dir, _BEFORE)
    changes = fingerprint_changes(now, before)
    return merged(before, now.join(changes.where("change = 'changed'").select("path"), "path", "left_semi"), changes, "path")


@query(f"select file, count(*) as edges, min(ord) as first_ord, max(ord) as last_ord from ({_METHODS}) m group by file")
def edges_by_file(spark, sf_dir):
    return _methods(spark, sf_dir).groupBy("file").agg(F.count("*").alias("edges"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


@query(f"select kind, source, target, confidence, file, line, col, ord, 1 as version from ({_METHODS}) m")
def snapshot_roundtrip(spark, sf_dir):
    folder = urlparse(shared_folder(spark)).path + f"/snapshot-{uuid.uuid4().hex[:8]}"
    store = SnapshotStore(spark, folder, folder)
    store.save({"edges": _methods(spark, sf_dir)}, {"shape": "x"})
    meta, tables = store.load()
    return tables["edges"].withColumn("version", F.lit(meta["version"]))


# --- Extraction


def _extracted(language: str) -> None:
    """A query for a language: the relations of a small source for each document, and the same from its table."""
    extension, text, expected = SAMPLES[language]
    values = ", ".join(f"('{kind}', '{name}', {line}, '{confidence}')" for kind, name, line, confidence in expected)

    def run(spark, sf_dir):
        number = F.col("doc_id").cast("string")
        files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("src/f"), number, F.lit(extension)).alias("path"), F.replace(F.lit(text), F.lit("@"), number).alias("text"))
        return extract_files(files).where(F.col("kind").isin("definition", "import", "call", "inherit", "type-ref")).select("file", "kind", "name", "line", "confidence")

    QUERIES[f"extract_{language}"] = run
    ORACLE_SQL[f"extract_{language}"] = f"""select 'src/f' || cast(doc_id as varchar) || '{extension}' as file, kind, replace(name, '@', cast(doc_id as varchar)) as name, line, confidence
        from documents cross join (values {values}) v(kind, name, line, confidence)"""


for _language in SAMPLES:
    _extracted(_language)


# --- Names with slashes and dots


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.graph(spark, sf_dir, derive.PATHS)


_PATHS = derive.for_views(derive.PATHS)
_PATH_CALLS = rf"calls as (select *, lower(target) as t, lower(regexp_replace(regexp_extract(source, '[^/]*$'), '\.[^.]+$', '')) as caller from ({_PATHS}) g)"


@query(f"select path from ({_FILES}) f where lower(path) = 'spec.ts' or ends_with(lower(path), '/spec.ts') or ends_with(lower(path), '.spec.ts')")
def match_call_target(spark, sf_dir):
    return _files(spark, sf_dir).where(names.targets_symbol(F.col("path"), "Spec.ts")).select("path")


@query(f"""with p as (select lower(path) as p from ({_FILES}) f)
    select unnest(list_distinct(list_transform(list_filter(range(1, length(p) + 1), lambda i: i = 1 or substr(p, i - 1, 1) in ('/', '.')), lambda i: substr(p, i)))) as key, count(*) as n from p group by 1""")
def symbol_keys_dots(spark, sf_dir):
    keys = _files(spark, sf_dir).select(F.explode(names.symbol_keys(F.col("path"), True)).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))


@query(f"""with recursive {_PATH_CALLS},
    up(name, hop) as (select 'x1', 1 union select c.caller, u.hop + 1 from up u join calls c on c.t = u.name or ends_with(c.t, '/' || u.name) or ends_with(c.t, '.' || u.name) where u.hop < 6),
    first as (select name, min(hop) as hop from up group by name)
    select source, target, cast(min(hop) as int) as hop from calls join first on t = name or ends_with(t, '/' || name) or ends_with(t, '.' || name) group by source, target""")
def impact_suffixes(spark, sf_dir):
    """Impact sees names after slashes and dots at each hop."""
    return walk.upstream(_paths(spark, sf_dir), "X1", 6).select("source", "target", "hop")


_STARTS = ("x6", "x7", "x12", "x3")


@query(f"""with recursive {_PATH_CALLS},
    up(caller, chain, n) as (select caller, [ord], 1 from calls where t = 'x1' or ends_with(t, '/x1') or ends_with(t, '.x1')
        union all select c.caller, list_append(chain, c.ord), n + 1 from up u join calls c on c.t = u.caller or ends_with(c.t, '/' || u.caller) where n < 5),
    best as (select s.goal, chain, n from (select unnest([{_in(_STARTS)}]) as goal) s join up on up.caller = s.goal qualify row_number() over (partition by s.goal order by n, chain) = 1)
    select goal as start, cast(n - list_position(chain, ord) + 1 as int) as step, source, target from best join calls on list_contains(chain, ord)""")
def reachability_suffixes(spark, sf_dir):
    """A path's last call sees names after slashes and dots, the calls before it after slashes only."""
    edges, out = _paths(spark, sf_dir), spark.createDataFrame([], "start string, step int, source string, target string")
    for start in _STARTS:
        found = walk.reach(edges, start, "x1", 5)
        if found is not None:
            out = out.unionByName(found.select(F.lit(start).alias("start"), "step", "source", "target"))
    return out


# --- More of resolution, scopes and limits

_BOTH_FILES = "select 'app/' || source || '/' || lang || '.py' as file from documents where doc_id % 30 = 0 union select 'packages/' || lang || '/index.ts' from documents"


@query(f"""with f as ({_BOTH_FILES}), i as (select doc_id, 'app/' || source || '/' || lang || '.py' as here, 'packages/' || lang || '/index.ts' as there from documents)
    select doc_id, case when here in (select file from f) then here else there end as resolved from i""")
def import_precedence(spark, sf_dir):
    """A file beside the importing one goes before a package of the same name."""
    imports = _with_documents(spark, sf_dir, "select doc_id, 'app/' || source || '/main.py' as source, lang as specifier, false as script, '.py' as extension from documents")
    packages = _with_documents(spark, sf_dir, "select distinct 'packages/' || lang as dir, lang as name, 1 as ord from documents")
    return resolve.resolve_imports(imports, _with_documents(spark, sf_dir, _BOTH_FILES), packages, "doc_id")


#: Importing file, what it imports before and after a language's code, the extension, and files that are there by code.
_MODULES = (
    ("crate/src/lib.rs", "", "", ".rs", {"en": "crate/src/en/mod.rs", "de": "crate/src/de.rs"}),
    ("app/x/main.py", "..pkg.", "", ".py", {"en": "app/pkg/en/__init__.py", "fr": "app/pkg/fr.py"}),
    ("inc/main.c", "", ".h", ".c", {"en": "inc/en.h", "es": "inc/es.h"}),
    ("a/b/Main.java", "a.b.", "", ".java", {"en": "a/b/en.java", "de": "a/b/de.java"}),
)


@query(f"""select doc_id, resolved from documents join (values {", ".join(f"({k}, '{lang}', '{file}')" for k, m in enumerate(_MODULES) for lang, file in m[4].items())}) v(k, code, resolved)
    on doc_id % {len(_MODULES)} = k and lang = code""")
def import_modules(spark, sf_dir):
    """Rust modules, relative Python modules, C headers and Java classes."""
    table = spark.createDataFrame([(k, *m[:4]) for k, m in enumerate(_MODULES)], "k int, source string, before string, after string, extension string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.pmod("doc_id", F.lit(len(_MODULES))).cast("int").alias("k"))
    imports = docs.join(F.broadcast(table), "k").select("doc_id", "source", F.concat("before", "lang", "after").alias("specifier"), F.lit(False).alias("script"), "extension")
    files = spark.createDataFrame([(file,) for m in _MODULES for file in m[4].values()], "file string")
    return resolve.resolve_imports(imports, files, spark.createDataFrame([], "dir string, name string, ord int"), "doc_id")


@query(f"select path as file from ({_FILES}) f where path like 'packages/app/%'")
def scope_package(spark, sf_dir):
    """A scope names a package by the end of its directory."""
    edges = _files(spark, sf_dir).select(F.lit("definition").alias("kind"), F.col("path").alias("file"), F.lit("exact").alias("confidence"))
    return engine.filtered(edges, Query("callers", relation="definition", scope="app/"), {"x/y": "package", "packages/app": "package"}).select("file")


@query("select n_nationkey as asked, cast(greatest(1, least(20, n_nationkey)) as int) as depth, cast(greatest(1, least(200, n_nationkey * 12 - 20)) as int) as result_limit, cast(n_nationkey * 12 - 20 > 200 as int) as notes from nation")
def clamps(spark, sf_dir):
    """Depths and limits as they are put in force, and whether a limit was lowered."""
    rows = []
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("n")).collect():
        notes: list[dict] = []
        limit = present.clamp_limit(r.n * 12 - 20, notes)
        rows.append((r.n, walk.clamp_depth(r.n), limit, len(notes)))
    return spark.createDataFrame(rows, "asked long, depth int, result_limit int, notes int")


@query(f"select kind, source, target, line from ({_FK}) e where kind = 'definition' and target = 's3'")
def reachability_without_end(spark, sf_dir):
    """Reachability without an end is a filter of definitions and imports."""
    got = engine.answer(_fk(spark, sf_dir), Query("reachability", "S3"))
    rows = [(e["kind"], e["source"], e["target"], e["location"]["line"]) for p in got.paths for e in p["edges"]]
    return spark.createDataFrame(rows, "kind string, source string, target string, line int")


@query(f"select cast(count(*) as int) as total, cast(least(count(*), 200) as int) as returned, 1 as clamped from ({_FK}) e where kind = 'call' and target = 's3'")
def limit_cap(spark, sf_dir):
    got = engine.answer(_fk(spark, sf_dir), Query("callers", "s3", relation="call", limit=999))
    return spark.createDataFrame([(got.total, len(got.paths), sum("clamped" in d["message"] for d in got.diagnostics))], "total int, returned int, clamped int")
