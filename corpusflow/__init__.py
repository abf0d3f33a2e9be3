"""corpusflow: documents to a searchable, citable knowledge base, as Spark DataFrame plans."""
