"""palimpsest: corpus audit and controlled comparison as DataFrame operators on Spark."""
