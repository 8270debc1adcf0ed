"""Assessment of tables that keep growing."""
