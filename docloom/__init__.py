"""PySpark engine for document preprocessing, chunking and retrieval evaluation."""
