"""spindrift: a Spark-native crawl, scrape and corpus analytics engine."""

__version__ = "0.1.0"
