"""Where the star comes from: declared schemas, stored tables, conformed parquet, generators."""
