"""DataFrame jobs: per-file tables, project rollups, rankings, comparison, reports."""
