"""Sources and sinks: landed extracts, normalisation, the table store, exports."""
