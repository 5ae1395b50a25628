"""Table, folder and page sources."""
