"""A PySpark engine for the contents of multitrack-recorder media, with training-data operators beside it."""
