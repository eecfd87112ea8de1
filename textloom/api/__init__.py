"""Ways in for users: an object over single texts, SQL functions, a command line and a small service."""
