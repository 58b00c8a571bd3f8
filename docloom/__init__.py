"""docloom: document-intelligence queries expressed as Spark DataFrame jobs."""
