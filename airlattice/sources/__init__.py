"""Sources and sinks: landed payloads, reading files, catalogues, stores, registries."""
