"""tidemark: entity-traction analytics and corpus operators on Spark."""
