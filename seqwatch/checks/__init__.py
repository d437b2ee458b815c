"""The operators run on the test tables, each beside the SQL it must agree with."""
