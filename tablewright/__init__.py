"""A Spark-first engine for evidence-backed tables: text cleaning, entity resolution, provenance merge, coverage, truth and audit."""
