"""tidemark: a PySpark analytics engine for paired-venue order books, with training-data operators in tidemark.llm."""
