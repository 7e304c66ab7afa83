"""Tables, lookups and literal rows."""
