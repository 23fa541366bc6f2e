"""Resolution of calls and imports as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import short_name
from ..functions.paths import directory, normalized

# What an import may leave out, in the order in which it is tried.
SCRIPT_LADDER = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
PACKAGE_LADDER = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


#: A name is hot if more than 1 / HOT_SHARE of all calls (and more than HOT_LEAST) have it, so at most HOT_SHARE names are.
HOT_SHARE, HOT_LEAST = 1000, 10_000


def by_name(calls: DataFrame, names: DataFrame) -> DataFrame:
    """calls left-joined with names (one row for each `name`). Hot names, of which the number is bounded, are broadcast, so
    that their calls stay where they are; the others meet in a shuffle."""
    count = calls.groupBy("name").agg(F.count("*").alias("n"))
    floor = F.greatest(F.lit(HOT_LEAST), calls.agg(F.count("*") / HOT_SHARE).scalar())
    hot = count.where(F.col("n") > floor).select("name", F.lit(True).alias("hot"))
    marked = calls.join(F.broadcast(hot), "name", "left")
    few = names.join(F.broadcast(hot), "name", "left_semi")
    return marked.where("hot").join(F.broadcast(few), "name", "left").unionByName(marked.where("hot is null").join(names, "name", "left")).drop("hot")


def resolve_calls(edges: DataFrame) -> DataFrame:
    """Relabels call edges from all definitions, and rewrites short names of methods that have one definition.

    Per call, by lower-cased names: a definition of the full name leaves the call as it is; otherwise the definitions
    with that short name count. None: heuristic. One in the call's own file: its qualified name, exact. One in all: its
    qualified name, inferred. Several: heuristic. Definitions are aggregated before the joins, so a name that is defined
    or called very often doesn't multiply rows; the calls of a hot name aren't sent to one task.
    """
    defs = edges.where("kind = 'definition'").select(F.lower("target").alias("full"), "target", "file")
    defs = defs.withColumn("short", short_name(F.col("full")))
    # Names with their definitions' counts: as full names, as short names, and as short names by file.
    full = defs.groupBy(F.col("full").alias("name")).agg(F.lit(True).alias("known"))
    methods = defs.where("short <> full")
    short = methods.groupBy(F.col("short").alias("name")).agg(F.count("*").alias("n_all"), F.min("target").alias("t_all"))
    own = methods.groupBy(F.col("short").alias("name"), "file").agg(F.count("*").alias("n_own"), F.min("target").alias("t_own"))
    calls = edges.where("kind = 'call'").withColumn("name", F.lower("target"))
    calls = by_name(calls, full.join(short, "name", "full_outer")).join(own, ["name", "file"], "left")
    branch = (
        F.when(F.col("known"), "full")
        .when(F.col("n_all").isNull(), "none")
        .when(F.col("n_own") == 1, "samefile")
        .when(F.col("n_all") == 1, "unique")
        .otherwise("multiple")
    )
    calls = calls.withColumn("branch", branch)
    target = F.when(F.col("branch") == "samefile", F.col("t_own")).when(F.col("branch") == "unique", F.col("t_all")).otherwise(F.col("target"))
    label = F.when(F.col("branch") == "full", F.col("confidence")).when(F.col("branch") == "samefile", "exact").when(F.col("branch") == "unique", "inferred").otherwise("heuristic")
    calls = calls.withColumn("target", target).withColumn("confidence", label)
    return edges.where("kind <> 'call'").withColumn("branch", F.lit(None).cast("string")).unionByName(calls.select(*edges.columns, "branch"))


def first_file(candidates: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, resolved): the first of each key's `candidates` (array) that is a file."""
    tried = candidates.select(key, F.posexplode("candidates").alias("pos", "path"))
    hits = tried.join(files.select(F.col("file").alias("path")).distinct(), "path")
    return hits.groupBy(key).agg(F.min_by("path", "pos").alias("resolved"))


def _ladder(base: Column, steps: tuple[str, ...]) -> Column:
    return F.array(*(F.concat(base, F.lit(s)) for s in steps))


def script_candidates(source: Column, specifier: Column) -> Column:
    """Files that a relative import of a script may mean; null for others."""
    base = normalized(F.concat(directory(source), F.lit("/"), specifier))
    return F.when(specifier.startswith("."), _ladder(base, SCRIPT_LADDER))


def package_of_specifier(specifier: Column) -> Column:
    """`name` or `@scope/name`; null for a scope alone."""
    parts = F.split(specifier, "/")
    scoped = F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), "/"))
    return F.when(specifier.startswith("@"), scoped).otherwise(parts[0])


def package_candidates(specifier: Column, package_dir: Column) -> Column:
    """Files inside a package that an import may mean."""
    parts = F.split(specifier, "/")
    skip = F.when(specifier.startswith("@"), 2).otherwise(1)
    base = F.array_join(F.concat(F.array(package_dir), F.slice(parts, skip + 1, F.greatest(F.size(parts) - skip, F.lit(0)))), "/")
    return _ladder(base, PACKAGE_LADDER)


def module_candidates(source: Column, specifier: Column, extension: Column) -> Column:
    """Files that an import of another language may mean: the path as written, then the module as file, with the
    language's extension, as Python package or as Rust module directory, next to the importing file and from the root."""
    here = directory(source)
    raw = F.trim(F.replace(specifier, F.lit("\\"), F.lit("/")))
    join = lambda rest: normalized(F.concat(here, F.lit("/"), rest))
    literal = F.when(raw.contains(".") | raw.contains("/"), F.array(join(raw), F.regexp_replace(raw, r"^\./", ""))).otherwise(F.array().cast("array<string>"))
    dots = F.length(F.regexp_extract(raw, r"^(\.+)\w", 1))
    rest = F.regexp_replace(F.regexp_replace(raw, r"^\.+", ""), r"\.", "/")
    spec = F.when(dots == 1, F.concat(F.lit("./"), rest)).when(dots > 1, F.concat(F.repeat(F.lit("../"), dots - 1), rest)).otherwise(raw)
    words = F.filter(F.split(spec, "[./]"), lambda x: x != "")
    last = F.when(F.size(words) > 0, F.element_at(words, -1)).otherwise(spec)
    bases = F.when(spec.startswith("."), F.array(join(spec))).otherwise(F.array(join(last), normalized(F.replace(spec, F.lit("."), F.lit("/"))), normalized(spec)))
    forms = lambda b: F.array(b, F.concat(b, extension), F.concat(b, F.lit("/__init__.py")), F.concat(b, F.lit("/mod.rs")))
    every = F.concat(literal, F.flatten(F.transform(bases, forms)), F.array(join(F.concat(last, extension))))
    return F.transform(every, lambda x: F.regexp_replace(x, r"^\./", ""))


def resolve_imports(imports: DataFrame, files: DataFrame, packages: DataFrame, key: str) -> DataFrame:
    """(key, resolved) of imports (key, source, specifier, script, extension): the local file, else the package's file.
    Unresolved imports have no row. packages: (dir, name)."""
    script = script_candidates(F.col("source"), F.col("specifier"))
    other = module_candidates(F.col("source"), F.col("specifier"), F.col("extension"))
    local = first_file(imports.select(key, F.when(F.col("script"), script).otherwise(other).alias("candidates")).where("candidates is not null"), files, key)
    named = packages.where("name is not null").groupBy("name").agg(F.min_by("dir", "ord").alias("dir")).where("dir <> ''")
    named = imports.withColumn("name", package_of_specifier(F.col("specifier"))).join(named, "name")
    remote = first_file(named.select(key, package_candidates(F.col("specifier"), F.col("dir")).alias("candidates")), files, key)
    both = local.withColumnRenamed("resolved", "here").join(remote.withColumnRenamed("resolved", "there"), key, "full_outer")
    return both.select(key, F.coalesce("here", "there").alias("resolved"))


def covered_interfaces(interfaces: DataFrame, types: DataFrame) -> DataFrame:
    """(file, iface, type): types of the same file whose methods cover all methods of a (non-empty) interface; from
    interfaces (file, iface, method) and types (file, type, method). Relational division by counting."""
    wanted = interfaces.distinct().groupBy("file", "iface").agg(F.count("*").alias("wanted"))
    met = interfaces.distinct().join(types.distinct(), ["file", "method"]).where("iface <> type").groupBy("file", "iface", "type").agg(F.count("*").alias("met"))
    return met.join(wanted, ["file", "iface"]).where("met = wanted").select("file", "iface", "type")


def package_of(files: DataFrame, packages: DataFrame) -> DataFrame:
    """file and the longest package directory that holds it (null without one). A file joins its own directories."""
    parts = F.split("file", "/")
    parents = files.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n - 1), "/"))).alias("dir"))
    dirs = packages.where("dir <> ''").select("dir").distinct().withColumn("found", F.col("dir"))
    return parents.join(dirs, "dir", "left").groupBy("file").agg(F.max_by("found", F.length("found")).alias("package_dir"))
