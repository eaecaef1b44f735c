"""Statement reconciliation against an accounting ledger, as Spark jobs."""
