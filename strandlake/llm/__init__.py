"""Training-data operators over whole text tables.  Nothing outside this subpackage imports it."""
