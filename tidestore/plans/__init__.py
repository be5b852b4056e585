"""Named queries over the driver's tables, with SQL twins."""
