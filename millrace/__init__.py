"""A PySpark library that turns case documents into curated datasets and measures predictions made on them."""
