"""The registered queries: each operator over whole tables, with the SQL that must give the same rows."""
