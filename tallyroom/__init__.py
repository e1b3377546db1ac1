"""Market series, news-feed curation and data-quality audit as Spark DataFrame jobs."""
