"""The operators bound to the driver's tables, each beside the SQL it must agree with."""
