"""Sources and sinks: source trees, bundles, configuration, labels."""
