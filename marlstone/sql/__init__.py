"""The SQL front end."""
