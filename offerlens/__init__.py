"""Job-offer observatory on Spark: intake, history, classification, publication, read models."""
