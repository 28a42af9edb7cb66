"""Where tables come from and go to: Parquet, versioned stores and JSON documents."""
