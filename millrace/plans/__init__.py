"""Programs, jobs and worked analyses."""
