"""tallywell: product, operations and document analytics as Spark DataFrame plans."""
