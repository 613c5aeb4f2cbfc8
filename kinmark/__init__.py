"""Record linkage on Spark: text normalisation, blocking, candidate scoring, decisions and reports."""
