"""Source trees, packages and snapshots."""
