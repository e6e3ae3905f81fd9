"""The registered queries, each with the SQL that it is compared with."""
