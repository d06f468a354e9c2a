"""Spark jobs that find unusual client sessions in application request logs."""
