"""docweft: document intelligence, text-corpus and run-log analytics as Spark jobs."""
