"""The SQL front end: dialect, statements and the tables of a session."""
