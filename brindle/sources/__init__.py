"""Document tables, event logs and versioned stores."""
