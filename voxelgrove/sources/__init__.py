"""Where volumes come from: tables, archives, TIFF stacks, text tables."""
