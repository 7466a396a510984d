"""Social-content analytics expressed as Spark plans."""
