"""Table, merge-list and file sources, and the sinks."""
