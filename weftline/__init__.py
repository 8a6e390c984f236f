"""Document, retrieval and chat analytics expressed as Spark DataFrame operators."""
