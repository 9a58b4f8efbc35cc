"""ledgerloom: behaviour enrichment of transaction tables as Spark jobs."""
