"""Sources and sinks: lossless tables, snapshots, results, catalogues."""
