"""Sources, readers and sinks."""
