"""Models trained by Spark: classification, regression, clustering, patterns."""
