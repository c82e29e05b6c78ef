"""Sources and sinks: readers, keyed writes, and adapters from the driver's tables."""
