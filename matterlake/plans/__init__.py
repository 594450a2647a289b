"""Plan shapes that several operators share, and composed jobs."""
