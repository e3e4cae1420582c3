"""The operators put together: queries over the standard tables, reports."""
