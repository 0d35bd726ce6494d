"""Change-feed transfer on Spark: read, group, transform, dedupe and merge table changes."""
