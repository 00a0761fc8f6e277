"""plyforge: Spark jobs that turn annotated game archives into task rows and score model answers."""
