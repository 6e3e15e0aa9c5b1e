"""Named queries over whole tables, and the SQL they are checked against."""
