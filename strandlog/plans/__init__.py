"""The event log: its layout, registry, segments and checks."""
