"""Price files, calendars, tables and generated streams."""
