"""The query catalog: each entry pairs a Spark plan with the SQL that checks it."""
