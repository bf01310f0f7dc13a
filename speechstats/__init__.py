"""speechstats: batch and streaming Spark jobs for the temporal analysis of transcribed speech."""
