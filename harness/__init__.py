"""Running the library on the driver's tables: adapters, queries and their oracles."""
