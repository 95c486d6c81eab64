"""Where commit graphs come from: driver tables and repositories."""
