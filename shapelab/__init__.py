"""shapelab: shape, similarity and text analytics expressed as Spark DataFrame plans."""
