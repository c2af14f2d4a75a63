"""Document, page, text-run and pixel jobs on Spark."""
