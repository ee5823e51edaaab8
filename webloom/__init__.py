"""webloom: analytics over captured web corpora, expressed as Spark DataFrame plans."""
