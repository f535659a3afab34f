"""Training-data operators. Nothing outside this subpackage imports it, but for the
guarded registration in ``__spark_entry__``."""
