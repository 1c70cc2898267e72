"""The library's jobs on the driver's tables, with the SQL that checks them."""
