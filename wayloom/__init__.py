"""Road-network analytics and text preparation as Spark jobs."""
