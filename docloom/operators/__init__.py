"""Table operators: chunking and evaluation."""
