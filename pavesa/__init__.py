"""Emergency-data analytics (hotspots, warnings, burnt area, roads, settlements) as Spark jobs."""
