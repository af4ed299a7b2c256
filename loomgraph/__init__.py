"""loomgraph: a Spark-native engine for hierarchical knowledge-graph retrieval and training-data preparation."""
