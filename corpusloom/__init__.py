"""A PySpark engine for language-corpus and dialogue-dataset processing."""
