"""Binary formats, read from any store as files in rows."""
