"""Query builders: each module pairs DataFrame queries over the project's tables with SQL for the same result."""
