"""corpusloom: curation, retrieval and evaluation of text corpora as Spark DataFrame pipelines."""
