"""Change tables safely on Spark: sandbox snapshots, rewrites and table-vs-table checks."""
