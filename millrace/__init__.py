"""Content analytics as Spark jobs: operators, sources, functions, plans and streams."""
