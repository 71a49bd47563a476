"""DataFrame operators: look-ups, joins, roll-ups, rankings."""
