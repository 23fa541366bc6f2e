"""The sentences of diagnostics, with named places."""

from __future__ import annotations

# A response holds these sentences beside its codes, so they must be the ones that users have today.
MESSAGES = {
    "file_count_stop": "scan stopped at {files} files; raise max_files to index more",
    "file_oversize": "{path} is {size} bytes (cap {cap})",
    "file_binary": "{path} looks binary (NUL or control bytes)",
    "file_decode_failed": "{path} is not decodable as UTF-8 or a known BOM encoding",
    "no_budget": "index build/refresh required and the timeout budget is exhausted; retry the same query",
    "late": "index build/refresh exceeded {ms}ms; retry the same query",
    "failed": "extraction failed for {path}",
    "deviations": "index deviations occurred; see accompanying diagnostics",
    "limit_clamped": "limit {limit} clamped to hard cap {cap}",
    "depth_clamped": "max_depth {depth} clamped to hard cap {cap}",
    "more_relations": "{n} more relations beyond limit",
    "more_candidates": "{n} more candidates beyond limit",
    "more_impact": "impact edges beyond limit",
    "unknown_target": "no graph node matches '{target}'",
    "ambiguous_target": "{n} symbols match '{target}'; disambiguate by path or qualified name",
    "no_path": "no call path from {source} to {target}",
    "no_path_within": "no call path from {source} to {target} within depth {depth}",
    "invalid_mode": "mode must be one of {modes}",
}


def message(name: str, **values) -> str:
    return MESSAGES[name].format(**values)
