"""talentlake: labor-market and text analytics on PySpark."""
