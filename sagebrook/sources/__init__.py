"""Reading, writing, upserting and versioning of tables."""
