"""Sources and sinks: pages, calendars, the event store, reports."""
