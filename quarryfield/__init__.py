"""Multi-tenant records with fields declared at run time, queried on Spark."""
