"""Reading the event log, container logs and stored tables; writing tables and nested answers."""
