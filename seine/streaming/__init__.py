"""The row-local part of a scan over streams."""
