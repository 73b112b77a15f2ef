"""Views of input tables, and the SQL and table-browser front."""
