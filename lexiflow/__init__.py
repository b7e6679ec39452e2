"""lexiflow: DataFrame operators for reading, catalogue and pointer-event data."""
