"""Named queries over a data folder, with their SQL checks."""
