"""Sources, catalogs and sinks."""
