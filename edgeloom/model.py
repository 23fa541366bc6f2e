"""Vocabulary, limits and schemas of the relation graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The vocabulary of the tool's answers.
KINDS = ("definition", "call", "import", "inherit", "type-ref")
CONFIDENCES = ("exact", "inferred", "heuristic")
MODES = ("reachability", "callers", "impact")
DIAGNOSTIC_CODES = (
    "partial", "unsupported_language", "indexing", "truncated", "invalid_mode", "no_path",
    "ambiguous_target", "unknown_target", "file_oversize", "file_binary", "file_decode_failed", "file_count_stop",
)
STATUSES = ("built", "reused", "rebuilt", "incremental", "indexing", "empty")

# Limits of queries and scans.
DEFAULT_LIMIT, LIMIT_CAP = 50, 200
DEFAULT_DEPTH, DEPTH_CAP = 5, 20
DEQUEUE_GUARD = 64
SNIPPET_LINES, SNIPPET_CHARS = 3, 10_000
MAX_FILE_BYTES, MAX_FILES = 1_000_000, 50_000
TIMEOUT_MS, RETRY_AFTER_MS = 300_000, 1_000
SNAPSHOT_VERSION = 1

# The languages by file extension, and what extraction offers for each.
EXTENSION_LANGUAGE = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java",
    ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".php": "php", ".rb": "ruby", ".bash": "bash", ".sh": "bash",
    ".hs": "haskell", ".jl": "julia", ".scala": "scala",
}
SCANNED_EXTENSIONS = (*EXTENSION_LANGUAGE, ".razor")
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
# Directories that no scan enters, and the folder of our own store.
EXCLUDED_DIRECTORIES = (
    "node_modules", ".git", ".hg", ".svn", "dist", "build", "out", "coverage", ".edgeloom", ".cache", "vendor", "target",
    ".conda", "conda", "site-packages", ".venv", "venv", "__pycache__", ".claude", ".npm", ".pnpm-store",
)
_STAGES = {
    "P1": ("typescript", "tsx", "javascript", "jsx", "python", "go", "rust", "java"),
    "P2": ("c", "cpp", "csharp", "php", "ruby", "bash"),
    "P3": ("haskell", "julia", "scala", "razor"),
}
_PRECISION = {"php": "syntax+heuristic", "ruby": "syntax+heuristic", "bash": "syntax+heuristic", "razor": "markup-reduced"}
CAPABILITIES = {x: {"stage": stage, "precision": _PRECISION.get(x, "syntax+inferred")} for stage, names in _STAGES.items() for x in names}

#: Edges as all operators take them. `ord` is the order of emission: it decides every tie and every limit.
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("target", T.StringType(), False),
        T.StructField("confidence", T.StringType(), False),
        T.StructField("file", T.StringType(), False),
        T.StructField("line", T.IntegerType(), False),
        T.StructField("col", T.IntegerType(), False),
        T.StructField("ord", T.LongType(), False),
    ]
)
EDGE_COLUMNS = EDGE_SCHEMA.fieldNames()


@dataclass(frozen=True)
class ScanLimits:
    """Budgets and globs of a scan."""

    max_file_bytes: int = MAX_FILE_BYTES
    max_files: int = MAX_FILES
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Query:
    """A query; `query` (free text) is accepted and not used."""

    mode: str
    target: str | None = None
    relation: str | None = None
    confidence: str | None = None
    scope: str | None = None
    limit: int | None = None
    max_depth: int | None = None
    path_to: str | None = None
    include_snippets: bool = False
    refresh_timeout_ms: int | None = None
    query: str | None = None

    def __post_init__(self):
        for name, value, known in (("relation", self.relation, KINDS), ("confidence", self.confidence, CONFIDENCES)):
            if value is not None and value not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}")


@dataclass
class Answer:
    """Selected paths (lists of edges), candidates, counts and diagnostics."""

    paths: list[dict] = field(default_factory=list)
    candidates: list[dict] = field(default_factory=list)
    truncated: bool = False
    total: int = 0
    diagnostics: list[dict] = field(default_factory=list)
    impact: dict | None = None


def diagnostic(code: str, message: str) -> dict:
    if code not in DIAGNOSTIC_CODES:
        raise ValueError(f"unknown diagnostic {code}")
    return {"code": code, "message": message}
