"""Music-library analytics on PySpark: ingestion, views, clustering, similarity search, playlists."""
