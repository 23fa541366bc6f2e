"""The query engine: one tool, `explore`, over the index of a root."""

from __future__ import annotations

import json
import os
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import aliases_for, matches_alias, matches_import, matches_node, short_of, wanted_kinds
from ..functions.paths import forward, under
from ..messages import message
from ..model import CAPABILITIES, DEFAULT_DEPTH, DEPTH_CAP, EDGE_COLUMNS, MODES, RETRY_AFTER_MS, SNIPPET_CHARS, SNIPPET_LINES, TIMEOUT_MS, Answer, Query, ScanLimits, diagnostic
from ..operators import target as targets
from ..operators import walk
from ..operators.present import clamp_limit, edge_dict, scope_prefix
from .index import ProjectIndex

CONFIG = ".edgeloom/config.json"


def project_config(root: str) -> dict:
    """The project's own settings; nothing if there are none or they can't be read."""
    try:
        with open(os.path.join(root, CONFIG), encoding="utf-8") as f:
            found = json.load(f)
        return found if isinstance(found, dict) else {}
    except (OSError, ValueError):
        return {}


def limits_from(config: dict) -> ScanLimits:
    default = ScanLimits()
    return ScanLimits(int(config.get("max_file_bytes", default.max_file_bytes)), int(config.get("max_files", default.max_files)), tuple(config.get("include", ())), tuple(config.get("exclude", ())))


def _depth(query: Query, notes: list[dict]) -> int:
    depth = DEFAULT_DEPTH if query.max_depth is None else query.max_depth
    if depth > DEPTH_CAP:
        notes.append(diagnostic("partial", message("depth_clamped", depth=depth, cap=DEPTH_CAP)))
    return walk.clamp_depth(depth)


def filtered(edges: DataFrame, query: Query, packages: dict[str, str]) -> DataFrame:
    """Edges of the wanted kinds, with the confidence and in the scope asked for."""
    out = edges.where(F.col("kind").isin(*wanted_kinds(query.mode, query.relation)))
    if query.confidence is not None:
        out = out.where(F.col("confidence") == query.confidence)
    if query.scope is not None:
        out = out.where(under(forward(F.col("file")), scope_prefix(query.scope, packages)))
    return out


def _selected(found: walk.Selection, limit: int, notes: list[dict], more: str | None = None) -> Answer:
    if found.total > limit:
        notes = [*notes, diagnostic("truncated", more or message("more_relations", n=found.total - limit))]
    return Answer(paths=[{"edges": [edge_dict(r)]} for r in found.rows[:limit]], truncated=found.total > limit, total=found.total, diagnostics=notes)


def _no_path(notes: list[dict], query: Query, name: str, depth: int | None) -> Answer:
    why = "no_path" if depth is None else "no_path_within"
    return Answer(diagnostics=[*notes, diagnostic("no_path", message(why, source=name, target=query.path_to, depth=depth))])


def answer(edges: DataFrame, query: Query, packages: dict[str, str] | None = None, scan_notes: list[dict] | None = None) -> Answer:
    """The answer to a query on an edge table (EDGE_COLUMNS)."""
    edges = edges.select(*EDGE_COLUMNS)
    notes = list(scan_notes or [])
    if notes and all(n["code"] != "partial" for n in notes):
        notes.insert(0, diagnostic("partial", message("deviations")))
    own = [n for n in notes if n["code"] != "partial"]
    limit = clamp_limit(query.limit, notes)
    wanted = filtered(edges, query, packages or {})
    matching, name, needle = wanted, None, None
    if query.target is not None:
        found = targets.resolve(edges, query.target)
        if found.kind == "candidates":
            got = targets.candidate_answer(found.definitions, query.target, limit)
            got.diagnostics = [*notes, *got.diagnostics]
            return got
        name, needle = found.name, found.needle
        if found.kind == "miss":
            miss = Answer(diagnostics=[*own, diagnostic("unknown_target", message("unknown_target", target=query.target))])
            if query.relation != "import" or not needle:
                return miss
            matching = wanted.where(matches_import(F.col("target"), needle))
            if matching.isEmpty():
                return miss
        elif query.relation == "import":
            matching = wanted.where(matches_import(F.col("target"), needle) | F.lower("target").isin(*aliases_for(needle, name)))
        else:
            matching = wanted.where(matches_alias(F.col("target"), aliases_for(needle, name)))
    called = name or query.target or ""
    if query.mode == "reachability" and query.path_to is not None:
        depth = _depth(query, notes)
        chain = walk.reach(edges, called, query.path_to, depth)
        if chain is None:
            return _no_path(notes, query, called, depth)
        steps = chain.orderBy("step").collect()
        return Answer(paths=[{"edges": [edge_dict(r) for r in steps]}], total=len(steps), diagnostics=notes)
    if query.mode == "impact":
        depth = _depth(query, notes)
        if not called:
            return Answer(diagnostics=notes, impact={"direct": [], "transitive": [], "maxDepth": depth})
        walked = walk.upstream(edges, short_of(called.lower()), depth)
        anchor = walk.select(edges.where((F.col("kind") == "definition") & matches_node(F.col("target"), called)), limit)
        rest = walked.orderBy("hop", "rank").limit(limit).collect()
        direct, transitive = walk.impact_layers(walked)
        got = _selected(walk.Selection([*anchor.rows, *rest], anchor.total + walked.count()), limit, notes, message("more_impact"))
        got.impact = {"direct": direct, "transitive": transitive, "maxDepth": depth}
        return got
    if query.mode == "callers" and query.relation is None and query.target is not None:
        return _selected(walk.callers(edges, matching, limit), limit, notes)
    return _selected(walk.select(matching, limit), limit, notes)


class Engine:
    """Answers queries about a root. Scan limits come from the project's settings, overridden by `config`."""

    def __init__(self, spark: SparkSession, root: str, config: dict | None = None, enabled: bool = True):
        self.spark, self.root, self.enabled = spark, os.path.abspath(root), enabled
        self.config = {**project_config(self.root), **(config or {})}
        self.index = ProjectIndex(spark, self.root, limits_from(self.config))

    def _metadata(self, status: str | None = None, **more) -> dict:
        index = {"status": status or self.index.status, "files": self.index.files}
        if self.index.refreshed is not None:
            index["refreshedFiles"] = self.index.refreshed
        out = {"capabilities": CAPABILITIES, "index": {**index, **more}}
        return {**out, "packages": self.index.packages} if self.index.edges is not None else out

    def _response(self, mode: str, got: Answer, metadata: dict) -> dict:
        if got.impact is not None:
            metadata = {**metadata, "impact": got.impact}
        return {"mode": mode, "paths": got.paths, "candidates": got.candidates, "truncated": got.truncated, "total": got.total, "diagnostics": got.diagnostics, "metadata": metadata}

    def _indexing(self, mode: str, why: str) -> dict:
        note = Answer(diagnostics=[diagnostic("indexing", why)])
        return self._response(mode, note, self._metadata("indexing", progress=self.index.files, retryAfterMs=RETRY_AFTER_MS))

    def explore(self, mode: str | None = None, target: str | None = None, **options) -> dict:
        """One query; a refresh that takes longer than refresh_timeout_ms gives the status `indexing` and no edges."""
        if not self.enabled:
            raise RuntimeError("the engine is not enabled")
        if mode not in MODES:
            note = Answer(diagnostics=[diagnostic("invalid_mode", message("invalid_mode", modes=", ".join(MODES)))])
            return self._response(mode or "", note, {"capabilities": CAPABILITIES, "index": {"status": "empty"}})
        known = {f.name for f in fields(Query)}
        query = Query(mode, target, **{k: v for k, v in options.items() if k in known})
        budget = query.refresh_timeout_ms
        if budget is None:
            budget = int(self.config.get("build_timeout_ms", TIMEOUT_MS))
        if budget <= 0 and self.index.dirty():
            return self._indexing(mode, message("no_budget"))
        if budget > 0 and not self._fresh_within(budget):
            return self._indexing(mode, message("late", ms=budget))
        got = answer(self.index.edges, query, self.index.packages, self.index.diagnostics)
        if query.include_snippets:
            self._attach(got)
        return self._response(mode, got, self._metadata())

    def _fresh_within(self, budget_ms: int) -> bool:
        group, context = f"edgeloom-{uuid.uuid4().hex[:8]}", self.spark.sparkContext

        def work():
            context.setJobGroup(group, "index refresh", interruptOnCancel=True)
            self.index.ensure_fresh()

        pool = ThreadPoolExecutor(1)
        done = pool.submit(work)
        try:
            done.result(budget_ms / 1000)
            return True
        except Late:
            context.cancelJobGroup(group)
            return False
        finally:
            pool.shutdown(wait=False)

    def _attach(self, got: Answer) -> None:
        """Up to three lines of the source for each selected edge; none if the file can't be read."""
        texts: dict[str, list[str]] = {}
        for path in got.paths:
            for edge in path["edges"]:
                file, line = edge["location"]["file"], edge["location"]["line"]
                if file not in texts:
                    try:
                        with open(os.path.join(self.root, file), encoding="utf-8", errors="replace", newline="") as f:
                            texts[file] = re.split(r"\r?\n", f.read())
                    except OSError:
                        texts[file] = []
                lines = texts[file][max(0, line - 1) : max(0, line - 1) + SNIPPET_LINES]
                if lines:
                    edge["snippet"] = {"lines": [x[:SNIPPET_CHARS] for x in lines]}

    def explore_json(self, **query) -> str:
        """The response as JSON text."""
        return json.dumps(self.explore(**query), indent=2)

    def warmup(self) -> str:
        """Builds or refreshes the index; returns its status."""
        self.index.ensure_fresh()
        return self.index.status

    def diff_impact(self, symbols: list[str], most: int = 10) -> dict[str, dict]:
        """Impact of up to ten changed symbols."""
        return {s: self.explore("impact", s) for s in symbols[:most]}


_engines: dict[str, tuple[str, Engine]] = {}


def engine_for(spark: SparkSession, root: str, config: dict | None = None) -> Engine:
    """One engine for each root; another configuration replaces the former one."""
    key, shape = os.path.abspath(root), json.dumps(config or {}, sort_keys=True, default=str)
    if key not in _engines or _engines[key][0] != shape:
        _engines[key] = (shape, Engine(spark, key, config))
    return _engines[key][1]
