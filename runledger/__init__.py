"""Job-history analytics on Spark: batch-job logs in, run and usage tables out."""
