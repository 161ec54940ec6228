"""Where lines come from: files, tables, path lists, configuration."""
