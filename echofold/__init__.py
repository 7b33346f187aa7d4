"""echofold: duplicate, repetition and record analytics expressed as Spark DataFrame plans."""
