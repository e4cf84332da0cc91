"""Where vectors come from and go to: generators, raw binary files, CSV, tables, user functions."""
