"""A PySpark engine for corpora of notes: reading, chunking, search, verification and integrity checks."""
