"""sagebrook: document-corpus analytics as Spark DataFrame operators."""
