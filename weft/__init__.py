"""weft: a Spark-native analytics engine over an entity-component-relationship model."""
