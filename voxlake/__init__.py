"""voxlake: auditing, curation and evaluation of transcribed-speech and text corpora on Spark."""
