"""A PySpark engine that analyses and rewrites Elixir source at corpus scale."""
