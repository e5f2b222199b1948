"""Record curation, table cleaning, vector features and classifier evaluation on Spark."""
