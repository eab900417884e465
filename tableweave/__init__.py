"""tableweave: table curation, table evaluation and text-corpus operators as plain Spark jobs."""
