"""graphmill: a PySpark-native engine for graph minibatch preparation and corpus building."""
