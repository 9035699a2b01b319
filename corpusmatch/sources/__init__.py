"""Sources: landed feeds, pages and taxonomy releases to rows."""
