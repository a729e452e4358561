"""Word senses and their change over time, as Spark plans over text tables."""
