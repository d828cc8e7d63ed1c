"""termweave: a Spark-native review engine for medical terms in transcripts."""
