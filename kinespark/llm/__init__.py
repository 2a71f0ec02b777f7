"""Training-data operators on Spark: packing, token counts, mixing, sharding, line and
near-duplicate removal, chat formatting, vector search, quality rules and license scans."""
