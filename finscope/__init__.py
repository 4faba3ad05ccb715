"""finscope: finance-ledger data quality and migration scoping as PySpark jobs."""
