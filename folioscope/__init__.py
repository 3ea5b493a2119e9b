"""Evidence retrieval over long text, expressed as Spark DataFrame plans."""
