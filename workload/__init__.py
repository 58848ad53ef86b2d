"""The check workload: a code corpus derived from the driver tables, queries over it, and their SQL."""
