"""Sources and sinks: source trees, diffs, logs, reports and graph tables."""
