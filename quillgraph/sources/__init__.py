"""Where graphs come from and go to: logs, star-schema tables and generators."""
